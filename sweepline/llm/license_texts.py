"""Known licence texts: short licences in full, and the usual notice lines."""

from __future__ import annotations

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so"""

_MIT = f"""{_MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""

_SOURCE_AUTHORS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""

_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: identifier -> full text.
LICENSES: dict[str, str] = {
    "MIT": _MIT,
    "MIT-0": f"{_MIT_GRANT}.\n\n{_WARRANTY}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_SOURCE_AUTHORS}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_SOURCE_AUTHORS}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "Zlib": _ZLIB,
}

#: Longer licences by their canonical form (see licenses.py), as published by their stewards; with ``body``, without
#: the appendix on how to apply them. (identifier, paragraphs, digest of the first one, digest of the whole)
DIGESTS: tuple[tuple[str, int, str, str], ...] = (
    ("Apache-2.0", 27, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", 33, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Artistic-1.0-Perl", 29, "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", 13, "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 50, "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", "d2de41f78fbb7fa1b50ec20e3e5e400f6ffc0404352296de2818cda0722eba8b"),
    ("GFDL-1.2-only", 57, "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", "fdbd790ae9850ae81a2c777de181b7ceb77f56f8916bab9409c3a7724c8f131a"),
    ("GFDL-1.3-only", 60, "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", "36ea1c73ef2572444dde652ed4904bd9a5d41f91b984c64d2b712e8362408811"),
    ("GFDL-1.3-only", 67, "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", "9af8b09a25e07e574718758cdf5a64581433b2e9f0cd27bd6665cce5b182563b"),
    ("GPL-1.0-only", 35, "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", "59967477eafa5c999df136ce4729e98a72b0bde54cf327c732f475447201a313"),
    ("GPL-1.0-only", 50, "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", "b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f"),
    ("GPL-2.0-only", 44, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "393d838a3fcdf4be802c0512341c9f00cc4c10adb56ebbf01687ff37049a19dd"),
    ("GPL-2.0-only", 59, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123"),
    ("GPL-3.0-only", 109, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "c43a50259647db7e40be2c75b8e3df7d034442255f175578d6ef67ee51aec76d"),
    ("GPL-3.0-only", 122, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "f6b102946068e83c2ea9423a1546df8487d4197f0b0c7a32320ad6ae9f2cc3b8"),
    ("LGPL-2.0-only", 71, "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", "2d380dbc5ad94744c5d444af2bdcf1542b0848aa1587d6c7f3efb54e87ce54a5"),
    ("LGPL-2.0-only", 83, "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769"),
    ("LGPL-2.1-only", 73, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "e8fee7034b6432f7d6c16577b34654c02947180c540389d03e5e06c427f0f4f5"),
    ("LGPL-2.1-only", 85, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66"),
    ("LGPL-3.0-only", 37, "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 73, "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 77, "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", 83, "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", "aa185717d717a2d0ec717d00ea8c6ba918cd8e2afded564def246868987aafa2"),
)

_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: identifier -> titles that its steward or the SPDX list gives it.
TITLES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD 2-Clause Simplified License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD 3-Clause New or Revised License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{
        f"{short}-{version}-only": (f"GNU {long}, version {version}", f"GNU {long} v{version}", f"GNU {long} v{version} only", f"{short}-{version}", f"{short}v{version}")
        for short, long, versions in (
            ("GPL", "General Public License", ("2.0", "3.0")),
            ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
            ("AGPL", "Affero General Public License", ("3.0",)),
        )
        for version in versions
    },
    **{
        f"CC-{kind}-{version}": (f"CC {kind} {version}", f"Creative Commons {'-'.join(_CC[k] for k in kind.split('-'))} {version} {area}")
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
        for version, area in (("3.0", "Unported"), ("4.0", "International"))
    },
}
