"""Further known licence texts: short ones in full, long ones as digests of their canonical form."""

_BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MORE = tuple((n, title + t) for n, t, titles in (("BSD-3-Clause", _BSD3, ("", "BSD 3-Clause License\n\n", "All rights reserved.\n\n", "BSD 3-Clause License\n\nAll rights reserved.\n\n")), ("Unlicense", _UNLICENSE, ("", "The Unlicense\n\n"))) for title in titles) + (("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"))
#: Of the files as published: whole, without what follows the terms, and each with its paragraphs unwrapped.
DIGESTS = (
    ("Apache-2.0", "1b6ccfd91144d01a56851ec6e4daabe1042e707584fdcb25e2b1e08c09af4066"),
    ("Apache-2.0", "43bc395fa045e52db4fa1f7152ee2059523c69439c06e92c5e9b121ce735b29c"),
    ("Apache-2.0", "bdee29ce93a734e8d5d50b015f53c32074f4360e0312acae2cd5b2709a52e1a7"),
    ("Artistic-1.0-Perl", "ab9e0a4960f3366c6e09c86510fe9dd469d242185a905b440792fcc4a45b46ef"),
    ("CC0-1.0", "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137"),
    ("GFDL-1.2", "00bdde1398f0bde98ca378c0a47122b82b29e86d6e78e940b46f596363171ed5"),
    ("GFDL-1.2", "763fd67087ee54c1928a00c7e66bd59138dfa48fb7cf636fe42a828b1c489bcd"),
    ("GFDL-1.3", "7af376ab74fb47981bd638dc2604f95983cd08e09700ad2b7421c6be30e25ae3"),
    ("GFDL-1.3", "d76fb8c45f11b761aa1870334672b79fa828bbbd142bbd27f820e7f118b97ad6"),
    ("GPL-1.0", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-1.0", "99cfa3f6b6e4bac5e3744b085b7a08a9548066fbeea95402b0ece3ecb20f3b2c"),
    ("GPL-1.0", "b5bd3889f3288309a0cfa3c8da4c6abe71e7af97975f7eaa0093fdfc8994be7a"),
    ("GPL-1.0", "c419787c047686f1c435b2fe2ea394c78be30a2b8edc750a8cf8cd13fb40c459"),
    ("GPL-1.0", "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5"),
    ("GPL-1.0", "f8822f3b8baa5ee7d541ec73a6a2141adba3c8a35473139453e85fcb879f946e"),
    ("GPL-2.0", "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f"),
    ("GPL-2.0", "46f90fb5923e11bc5b072f6872fe391adbc25dd2046a33fe66ac15c717f3517f"),
    ("GPL-2.0", "558d3a6be635a3b0ca07ff08b438179240302950f4a599e0fcd60ef9fa76cfa4"),
    ("GPL-2.0", "799a572e4d4f9b17fb404b2715f24aa9d263feecc483bf950bbe428217d02ab0"),
    ("GPL-2.0", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-2.0", "a4e3bdf359b1d5d7cc26d8d788d55b2a35af24e5bd9c4e473673d64b2b1fd181"),
    ("GPL-3.0", "17d39ca668e772233bc30a426cc30cc00c20bc7544e4b68222fe549b85c4c2c8"),
    ("GPL-3.0", "364b9ec532739b053b76aadd8eff2901d097a9b32b2c3b38b47f954a5b5e96b2"),
    ("GPL-3.0", "4e0fbbfd6c7775a94b7e03bd0dc1df7f867d6aacc12c2b7acd7ceefd25acab79"),
    ("GPL-3.0", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),
    ("GPL-3.0", "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63"),
    ("GPL-3.0", "f3d91be43ac64baa63ecad5a4dffadd9eef077360b46bcac1f59daa8c1945fef"),
    ("LGPL-2.0", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0", "9d13cf53bf2cbeca5b76fbf2816c49e4187ffde010c14909d506a84660773425"),
    ("LGPL-2.0", "c8e7773f1b539b6afb141e4e0773b30ad0f8abca44985d7a1076ef134a514796"),
    ("LGPL-2.0", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),
    ("LGPL-2.0", "eb91bb22b0af719731a4905f9bc2923d43b0f01edbcdc6f5177fa10f54068eb1"),
    ("LGPL-2.0", "ffa24bc5ca08aeb22d84af37b873f2a2178e1b3cca53213d7adad860a352ea8c"),
    ("LGPL-2.1", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),
    ("LGPL-2.1", "adb763ba02d2c629ecc981f9321eed486b18442a33af68ff697b3bc561fcbfbc"),
    ("LGPL-2.1", "c7454b54bd0425fabe7e840c75eb337ef4c2f86630180bca8b6f04ac04ccc4c6"),
    ("LGPL-2.1", "d203bc167b87a561b06e0875df37e31508f1030f0b6c56bbfabc2f16acce8c65"),
    ("LGPL-2.1", "e752802878c7ac72bf51e585628a84a0aa3b422ca18af6ff12ff50b088c88d0d"),
    ("LGPL-3.0", "8526370d8935b50004a8465d23322588ba857da9b0bc19570cf346353d80a009"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "724757714a8157908a4262d37330f3ac617800181f14c5bb7ae1773611ef1af5"),
    ("MPL-2.0", "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791"),
)
