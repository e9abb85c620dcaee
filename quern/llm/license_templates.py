"""Templates of licences, as license-list markup. Fixed values."""

from __future__ import annotations

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of published licences and notices, with their labels. Words outside << >> are mandatory.
# <<beginOptional>> ... <<endOptional>> may be left out; <<var;name=...;original=...;match=...>> may be replaced: by one
# of the texts that | separates, or, for .{a,b}, by any a to b words.
TITLE = "<<beginOptional>><<var;name=title;original=The MIT License;match=the mit license|mit license>> <<beginOptional>>(MIT)<<endOptional>><<endOptional>>"
COPYRIGHT = "<<beginOptional>>Copyright <<var;name=holder;original=(c) 2020 The Authors;match=.{1,12}>> <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>"
WHO = "<<var;name=who;original=THE COPYRIGHT HOLDERS AND CONTRIBUTORS;match=the copyright holders and contributors|the author and contributors|the authors and contributors|the author|the authors|the regents and contributors>>"
OWNER = "<<var;name=owner;original=THE COPYRIGHT HOLDER OR CONTRIBUTORS;match=the copyright holder or contributors|the copyright owner or contributors|the copyright holders or contributors|the author or contributors|the authors or contributors|the author|the authors|the regents or contributors>>"

GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name=bullet;original=1.;match=.{0,1}>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name=bullet;original=2.;match=.{0,1}>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = """<<var;name=bullet;original=3.;match=.{0,1}>> Neither the name of <<var;name=organization;original=the copyright holder;match=.{1,12}>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
DISCLAIMER = f"""THIS SOFTWARE IS PROVIDED BY {WHO} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL {OWNER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

MIT = f"""{TITLE} {COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=what;original=this software and associated documentation files;match=this software and associated documentation files|this software>> <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holders;original=THE AUTHORS OR COPYRIGHT HOLDERS;match=the authors or copyright holders|the author or copyright holders|the copyright holders|the authors|the author>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = f"""{COPYRIGHT}
Permission to use, copy, modify, <<var;name=join;original=and/or;match=and or|and>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=who;original=THE AUTHOR DISCLAIMS;match=the author disclaims|isc disclaims|the authors disclaim>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=owner;original=THE AUTHOR;match=the author|isc|the authors>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

APACHE = f"""{COPYRIGHT}
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;name=address;original=http://www.apache.org/licenses/LICENSE-2.0;match=.{{1,10}}>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def gnu(name: str, version: str) -> str:
    """The notice that the GNU licences tell authors to attach."""
    return f"""is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}.
<<var;name=program;original=This program;match=.{{1,3}}>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


LATER = "either version {0} of the License, or (at your option) any later version"
LICENSED = "<<var;name=verb;original=licensed;match=licensed|released|distributed>> under <<beginOptional>>the terms of<<endOptional>>"
GENERAL = "the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"

TEMPLATES = (
    ("mit", MIT),
    ("bsd-2-clause", f"{COPYRIGHT} {GRANT} {DISCLAIMER}"),
    ("bsd-3-clause", f"{COPYRIGHT} {GRANT} {ENDORSE} {DISCLAIMER}"),
    ("isc", ISC),
    ("apache-2.0", APACHE),
    ("gpl-2.0-or-later", gnu("General Public License", LATER.format("2"))),
    ("gpl-3.0-or-later", gnu("General Public License", LATER.format("3"))),
    ("gpl-2.0-only", gnu("General Public License", "version 2 of the License")),
    ("gpl-3.0-only", gnu("General Public License", "version 3 of the License")),
    ("lgpl-2.1-or-later", gnu("Lesser General Public License", LATER.format("2.1"))),
    ("lgpl-3.0-or-later", gnu("Lesser General Public License", LATER.format("3"))),
    ("agpl-3.0-or-later", gnu("Affero General Public License", LATER.format("3"))),
)
"""Whole licences, or the whole notice where a licence is granted by a notice."""

NOTICES = (
    ("mit-notice", f"{LICENSED} the MIT License"),
    ("apache-2.0-notice", f"{LICENSED} the Apache License version 2.0"),
    ("gpl-2.0-notice", f"{LICENSED} {GENERAL} version 2"),
    ("gpl-3.0-notice", f"{LICENSED} {GENERAL} version 3"),
    ("lgpl-notice", "under <<beginOptional>>the terms of<<endOptional>> the GNU <<var;name=which;original=Lesser;match=lesser|library>> General Public License"),
    ("agpl-notice", "under <<beginOptional>>the terms of<<endOptional>> the GNU Affero General Public License"),
    ("cc-by-notice", f"{LICENSED} <<beginOptional>><<var;name=article;original=the;match=a|the>><<endOptional>> CC BY <<var;name=version;original=4;match=.{{1,1}}>> 0"),
    ("cc-by-nc-notice", f"{LICENSED} <<beginOptional>><<var;name=article;original=the;match=a|the>><<endOptional>> CC BY NC <<var;name=version;original=4;match=.{{1,1}}>> 0"),
    ("cc-by-sa-notice", f"{LICENSED} <<beginOptional>><<var;name=article;original=the;match=a|the>><<endOptional>> CC BY SA <<var;name=version;original=4;match=.{{1,1}}>> 0"),
    ("all-rights-reserved", "<<beginOptional>>copyright <<var;name=holder;original=2020 The Authors;match=.{1,8}>><<endOptional>> all rights reserved"),
)
"""Sentences that name a licence, or claim rights; they are no licence text."""
