"""Templates of the licence scan."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A statement of a licence; `must` are the words without which nothing counts as that licence, `never` those with
    which nothing does: they name a sister of it."""

    licence: str
    must: str
    statement: str
    never: str = ""


_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_OPENING = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org
"""
_BOOST = """
Boost Software License Version 1.0 August 17th 2003 Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
solely in the form of machine-executable object code generated by a source language processor.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution.
"""
_APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
_GPL_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have
received a copy of the GNU {kind}General Public License along with this program. If not, see https://www.gnu.org/licenses/
"""
_MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

#: Short statements, titles, notices and whole texts, as the licences' publishers word them.
TEMPLATES = (
    Template("AGPL-3.0", "affero 3", "Licensed under the GNU Affero General Public License, version 3"),
    Template("AGPL-3.0", "affero 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    Template("AGPL-3.0", "affero 3", _GPL_NOTICE.format(kind="Affero ", version="3")),
    Template("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0"),
    Template("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    Template("Apache-2.0", "apache 2", _APACHE_NOTICE),
    Template("BSD-2-Clause", "redistributions reproduce disclaimer", _BSD_OPENING + _BSD_DISCLAIMER),
    Template("BSD-3-Clause", "bsd style", "Use of this source code is governed by a BSD-style license"),
    Template("BSD-3-Clause", "bsd style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("BSD-3-Clause", "redistributions endorse disclaimer", _BSD_OPENING + _BSD_THIRD + _BSD_DISCLAIMER),
    Template("BSL-1.0", "boost 1", "Distributed under the Boost Software License, Version 1.0"),
    Template("BSL-1.0", "boost executable", _BOOST),
    Template("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0"),
    Template("CC-BY-4.0", "creative attribution 4", "Licensed under a Creative Commons Attribution 4.0 International License"),
    Template("CC-BY-NC-4.0", "cc nc 4", "Licensed under CC BY-NC 4.0"),
    Template("CC-BY-NC-4.0", "creative noncommercial 4", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("EPL-2.0", "eclipse 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("GPL-2.0", "gnu general 2", "Licensed under the GNU General Public License, version 2", never="library lesser affero documentation"),
    Template("GPL-2.0", "gnu general 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", never="library lesser affero documentation"),
    Template("GPL-2.0", "gnu general 2", _GPL_NOTICE.format(kind="", version="2"), never="library lesser affero documentation"),
    Template("GPL-3.0", "gnu general 3", "Licensed under the GNU General Public License, version 3", never="library lesser affero documentation"),
    Template("GPL-3.0", "gnu general 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", never="library lesser affero documentation"),
    Template("GPL-3.0", "gnu general 3", _GPL_NOTICE.format(kind="", version="3"), never="library lesser affero documentation"),
    Template("ISC", "isc license", "Released under the ISC License"),
    Template("ISC", "permission fee hereby", _ISC),
    Template("LGPL-2.1", "lesser 2 1", "Licensed under the GNU Lesser General Public License, version 2.1", never="affero"),
    Template("LGPL-2.1", "lesser 2 1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", never="affero"),
    Template("LGPL-2.1", "lesser 2 1", _GPL_NOTICE.format(kind="Lesser ", version="2.1"), never="affero"),
    Template("LGPL-3.0", "lesser 3", "Licensed under the GNU Lesser General Public License, version 3", never="affero"),
    Template("LGPL-3.0", "lesser 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", never="affero"),
    Template("LGPL-3.0", "lesser 3", _GPL_NOTICE.format(kind="Lesser ", version="3"), never="affero"),
    Template("MIT", "mit license", "Released under the MIT License"),
    Template("MIT", "mit license", "The MIT License (MIT) Copyright (c)"),
    Template("MIT", "permission sublicense furnished", _MIT),
    Template("LGPL-2.0", "library 2", "Licensed under the GNU Library General Public License, version 2", never="lesser affero"),
    Template("LGPL-2.0", "library 2", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", never="lesser affero"),
    Template("LGPL-2.0", "library 2", _GPL_NOTICE.format(kind="Library ", version="2"), never="lesser affero"),
    Template("GPL-1.0", "gnu general 1", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989", never="library lesser affero documentation"),
    Template("GPL-1.0", "gnu general 1", _GPL_NOTICE.format(kind="", version="1"), never="library lesser affero documentation"),
    Template("GFDL-1.2", "gnu documentation 1 2", "GNU Free Documentation License Version 1.2, November 2002"),
    Template("GFDL-1.3", "gnu documentation 1 3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    Template("MPL-1.1", "mozilla 1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    Template("MPL-1.1", "mozilla 1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    Template("CC0-1.0", "cc0 1", "Creative Commons Legal Code CC0 1.0 Universal"),
    Template("CC0-1.0", "cc0 1", "CC0 1.0 Universal"),
    Template("Artistic-1.0", "artistic preamble", 'The "Artistic License" Preamble'),
    Template("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    Template("MPL-2.0", "mozilla 2", _MPL_NOTICE),
    Template("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain"),
    Template("Unlicense", "unencumbered domain", _UNLICENSE),
    Template("Zlib", "altered misrepresented", _ZLIB),
)
#: SPDX identifiers that a tag may name.
IDENTIFIERS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def tags() -> tuple[Template, ...]:
    """One SPDX tag for each identifier; all of the identifier's words must be there."""
    return tuple(Template(name, f"spdx identifier {name.replace('-', ' ').replace('.', ' ')}", f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS)


ALL = TEMPLATES + tags()

#: Words that say nothing about a licence; no vector has them.
STOP = ("the", "this", "is", "of", "a", "an", "in", "to", "and", "or", "s", "v", "it", "that", "are", "be", "as")
