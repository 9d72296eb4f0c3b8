"""Digests of the long licence texts, as licenses.py makes them (the digest of the unwrapped text).

Made from the files of Debian's /usr/share/common-licenses by variants(): the whole file and the file
without its instructions for use, with http and https, and with the postal addresses that the
Free Software Foundation has had.
"""

from __future__ import annotations

#: Licence: file, and the line with which the instructions begin, if there are any.
FILES = {
    "Apache-2.0": ("Apache-2.0", "APPENDIX: How to apply"), "Artistic-1.0-Perl": ("Artistic", None), "BSD-3-Clause": ("BSD", None), "CC0-1.0": ("CC0-1.0", None),
    "GFDL-1.2": ("GFDL-1.2", "ADDENDUM: How to use"), "GFDL-1.3": ("GFDL-1.3", "ADDENDUM: How to use"), "GPL-1.0": ("GPL-1", "Appendix: How to Apply"), "GPL-2.0": ("GPL-2", "How to Apply These"), "GPL-3.0": ("GPL-3", "How to Apply These"),
    "LGPL-2.0": ("LGPL-2", "How to Apply These"), "LGPL-2.1": ("LGPL-2.1", "How to Apply These"), "LGPL-3.0": ("LGPL-3", None), "MPL-1.1": ("MPL-1.1", None), "MPL-2.0": ("MPL-2.0", None),
}
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307", "675 Mass Ave, Cambridge, MA 02139"]


def variants(text: str, instructions: str | None) -> list[str]:
    """The texts in use of a licence file, each once."""
    found = [text]
    if instructions and instructions in text:
        body = text[: text.rindex(instructions)].rstrip()
        found += [body, body.removesuffix("END OF TERMS AND CONDITIONS")]
    flat = [" ".join(x.split()) for x in ADDRESSES]
    out = []
    for x in found:
        x = "\n".join(" ".join(line.split()) for line in x.split("\n"))
        here = [a for a in flat if a in x]
        for y in [x] + [_swap(x, here, a) for a in flat if here]:
            out += [y, y.replace("http://", "https://"), y.replace("https://", "http://")]
            out += [z.replace("Lesser General Public License instead", "Library General Public License instead") for z in out[-3:]]
    return list(dict.fromkeys(out))


def _swap(text: str, here: list[str], new: str) -> str:
    for a in here:
        text = text.replace(a, new)
    return text


#: (licence, digest)
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd"),
    ("Apache-2.0", "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Apache-2.0", "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "04ef6dc34115806196d88d92e03f52b97ee22cb01cc73a59c06b30bd55f544c0"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.2", "1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2"),
    ("GFDL-1.2", "2bfb7cad161d35529e64dcca81918f6ca8c0718e801dd2e889ccb6017a81af5d"),
    ("GFDL-1.2", "4586dba5ddfcf100fb8904f8e9ed3b5c8475c6a35c144d40b2c7904ea874cef1"),
    ("GFDL-1.2", "5c083164ec08b233a6e2819c8c6d4f66a18fb74372858b0f8f418511dfd7adc0"),
    ("GFDL-1.2", "63010df9e01317a049c4911c8bf71d5557c0e38791419fd9853bf91dd13ded70"),
    ("GFDL-1.2", "8d08c74cec4dc000cf7c1c2967e04c1f2cfbb7b005c9db69c29b0fa77e4da921"),
    ("GFDL-1.2", "925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450"),
    ("GFDL-1.2", "a1f0df2b18313280767d46545d9055f62d3e43865e62729dcfd6ec0c0c240ca2"),
    ("GFDL-1.2", "a2607c0e38bcc0296add0ea58ccf09e2cc4d92b7aeb27c849b44435df616b905"),
    ("GFDL-1.2", "abde950e884038d48de4e25914809d22b5b0e7b256f045fb6da4c527d27d3510"),
    ("GFDL-1.2", "b3f53de985d43a22d37ed5ab33ce4180927631f694d75df1dfecdc006bbcfeb3"),
    ("GFDL-1.2", "db6f09831916c5579e026e27258750ad20217e2fdecb30d0d8730f2444777abf"),
    ("GFDL-1.2", "e078a7e8620cd0cf62ca224a8d44746755f79bde8c966eaee25db83b042c9a4c"),
    ("GFDL-1.3", "0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GFDL-1.3", "911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7"),
    ("GPL-1.0", "3b2524d27cb227016df68d1515394e8993b4bbf50c77d600de91a4399cb28f90"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f"),
    ("GPL-1.0", "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f"),
    ("GPL-1.0", "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0", "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a"),
    ("GPL-1.0", "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9"),
    ("GPL-2.0", "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a"),
    ("GPL-2.0", "160bd6a7cacc18e04e0460bf9e7e198825f8262cd78bb83a2366123237e6676e"),
    ("GPL-2.0", "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2"),
    ("GPL-2.0", "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0"),
    ("GPL-2.0", "3f52914b600e5d914201421b293f9720776f53c91d0bbaf88769b633a8e63acd"),
    ("GPL-2.0", "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518"),
    ("GPL-2.0", "41326808ad324a2d0a7d92184ee37e7903e2f17ceda2f0bdb2610155d8ab5cd9"),
    ("GPL-2.0", "417e800e7fd34292e96f28ba91c8080a4502d314a20935675860580402e8372b"),
    ("GPL-2.0", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "88883014c1fe63c13c3188405e7c425b67cc7cb087c7fa51f694dbfb6976bc8e"),
    ("GPL-2.0", "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd"),
    ("GPL-2.0", "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225"),
    ("GPL-2.0", "c8f000ebba7aed88932bac16e39854cb45468a420c750f4497420c24a3916d29"),
    ("GPL-2.0", "c8f9d5b93c197559d743ed3d8bf8635696ebe78086333cbe6f0a3ab143d43f25"),
    ("GPL-2.0", "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960"),
    ("GPL-2.0", "dcd7b97a58f002cca117b733640dd811ce0436beab20bbe888234d58c6198aec"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "e249f505e62dffe815578ec3db5a6db73656b478c8009135cab65e1168f7dc96"),
    ("GPL-2.0", "e92f1fb18f85245a26c26118f0f9fffa2938ca691a90033b02a7648f9cead700"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2"),
    ("LGPL-2.0", "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d"),
    ("LGPL-2.0", "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31"),
    ("LGPL-2.0", "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318"),
    ("LGPL-2.0", "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108"),
    ("LGPL-2.0", "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1"),
    ("LGPL-2.0", "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380"),
    ("LGPL-2.1", "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87"),
    ("LGPL-2.1", "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4"),
    ("LGPL-2.1", "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0"),
    ("LGPL-2.1", "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb"),
    ("LGPL-2.1", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-2.1", "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]
