"""Signature rules for licence statements, in order of priority.

Patterns are matched against the words of a text (lower case, joined by single spaces, punctuation gone), so ``4.0`` is
``4 0``. Each rule names a keyword that must occur before its pattern is tried. ``TITLES`` holds the names of licences,
``NOTICES`` sentences of their full texts and file headers, ``MENTIONS`` weaker signs; these are written by hand. Each
title also gives a grant rule ("licensed under ..."), each label an identifier rule, which rank above the bare title.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Ranks of the kinds of rule; a detection inside one of a higher rank, or inside a longer one of the same rank, is dropped.
IDENTIFIER, NOTICE, GRANT, TITLE, FAMILY, MENTION = 100, 90, 80, 70, 50, 30


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


V = r"(?: version| v)?"
#: (label, keyword, pattern of the name, rank)
TITLES: tuple[tuple[str, str, str, int], ...] = (
    ("mit", "licen", r"mit licen[sc]e", FAMILY),
    ("mit", "licen", r"(?:the )?mit (?:expat )?licen[sc]e mit", TITLE),
    ("mit", "expat", r"expat licen[sc]e", TITLE),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", TITLE),
    ("x11", "x11", r"x11 licen[sc]e", TITLE),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[sc]e{V} 2(?: 0)?", TITLE),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[sc]e{V} 1 1", TITLE),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[sc]e{V} 1 0", TITLE),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", FAMILY),
    ("apache-2.0", "apache", r"apache 2 0", TITLE),
    ("gpl-3.0", "public licen", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?", TITLE),
    ("gpl-3.0-or-later", "public licen", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)? or (?:any )?(?:\(?at your option\)? )?(?:any )?later(?: version)?", TITLE + 2),
    ("gpl-2.0", "public licen", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?", TITLE),
    ("gpl-2.0-or-later", "public licen", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)? or (?:any )?(?:at your option )?(?:any )?later(?: version)?", TITLE + 2),
    ("gpl-1.0", "public licen", rf"(?:gnu )?general public licen[sc]e{V} 1(?: 0)?", TITLE),
    ("gpl", "public licen", r"(?:gnu )?general public licen[sc]e", FAMILY),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?", TITLE),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?", TITLE),
    ("gpl", "gpl", r"gnu gpl", FAMILY),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?", TITLE + 1),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1", TITLE + 1),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general public licen[sc]e{V} 2(?: 0)?", TITLE + 1),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", FAMILY + 1),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?", TITLE),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1", TITLE),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", FAMILY),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?", TITLE + 1),
    ("agpl-1.0", "affero", rf"affero general public licen[sc]e{V} 1(?: 0)?", TITLE + 1),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", FAMILY + 1),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?", TITLE),
    ("agpl", "agpl", r"(?:gnu )?agpl", FAMILY),
    ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation licen[sc]e{V} 1 3", TITLE),
    ("gfdl-1.2", "free documentation", rf"(?:gnu )?free documentation licen[sc]e{V} 1 2", TITLE),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", FAMILY),
    ("bsd-0-clause", "0bsd", r"0bsd", TITLE),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd(?: licen[sc]e)?", TITLE),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:bsd 2|2|two) clause(?: bsd)?(?: licen[sc]e)?", FAMILY),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd licen[sc]e", TITLE),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?", TITLE),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: new| revised)?(?: licen[sc]e)?", TITLE),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?", TITLE),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[sc]e", TITLE),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?", TITLE),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", FAMILY),
    ("isc", "isc", r"isc licen[sc]e", TITLE),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", TITLE),
    ("libpng", "libpng", r"libpng licen[sc]e", TITLE),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{V} 2(?: 0)?", TITLE),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{V} 1 1", TITLE),
    ("mpl-1.0", "mozilla", rf"mozilla public licen[sc]e{V} 1 0", TITLE),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", FAMILY),
    ("mpl-2.0", "mpl", r"mpl ?v?2 0", TITLE),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{V} 2(?: 0)?", TITLE),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{V} 1(?: 0)?", TITLE),
    ("epl", "eclipse", r"eclipse public licen[sc]e", FAMILY),
    ("edl-1.0", "eclipse", rf"eclipse distribution licen[sc]e{V} 1(?: 0)?", TITLE),
    ("cddl-1.1", "cddl", r"cddl ?v?1 1", TITLE),
    ("cddl-1.0", "cddl", r"cddl ?v?1 0", TITLE),
    ("cddl", "common development", r"common development and distribution licen[sc]e", FAMILY),
    ("cpl-1.0", "common public", rf"common public licen[sc]e{V} 1(?: 0)?", TITLE),
    ("ipl-1.0", "ibm", rf"ibm public licen[sc]e(?:{V} 1(?: 0)?)?", TITLE),
    ("eupl-1.2", "european union", rf"european union public licen[sc]e{V} 1 2", TITLE),
    ("eupl-1.1", "european union", rf"european union public licen[sc]e{V} 1 1", TITLE),
    ("eupl", "eupl", r"eupl(?: v?1 [12])?", FAMILY),
    ("cecill-2.1", "cecill", rf"cecill(?: free software)?(?: licen[sc]e)?{V} 2 1", TITLE),
    ("cecill-b", "cecill", r"cecill b", TITLE),
    ("cecill-c", "cecill", r"cecill c", TITLE),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e{V} 2(?: 0)?", TITLE),
    ("artistic-1.0", "artistic", rf"artistic licen[sc]e{V} 1(?: 0)?", TITLE),
    ("artistic", "artistic", r"artistic licen[sc]e", FAMILY),
    ("psf-2.0", "python software", rf"python software foundation licen[sc]e(?:{V} 2(?: 0)?)?", TITLE),
    ("ruby", "ruby", r"(?:the )?ruby licen[sc]e", TITLE),
    ("php-3.01", "php", rf"php licen[sc]e(?:{V} 3 01)?", TITLE),
    ("bsl-1.0", "boost", rf"boost software licen[sc]e(?:{V} 1(?: 0)?)?", TITLE),
    ("bsl-1.1", "business source", rf"business source licen[sc]e(?:{V} 1 1)?", TITLE),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", TITLE),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e", TITLE),
    ("wtfpl", "wtfpl", r"wtfpl", TITLE),
    ("wtfpl", "public licen", r"do what the fuck you want to public licen[sc]e", TITLE),
    ("beerware", "beer", r"(?:the )?beer ?ware licen[sc]e", TITLE),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", TITLE),
    ("openssl", "openssl", r"openssl licen[sc]e", TITLE),
    ("vim", "vim", r"vim licen[sc]e", TITLE),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v?1 0)?", TITLE),
    ("afl-3.0", "academic free", rf"academic free licen[sc]e(?:{V} 3(?: 0)?)?", TITLE),
    ("osl-3.0", "open software", rf"open software licen[sc]e(?:{V} 3(?: 0)?)?", TITLE),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", TITLE),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", TITLE),
    ("apsl-2.0", "apple", rf"apple public source licen[sc]e(?:{V} 2(?: 0)?)?", TITLE),
    ("lppl-1.3c", "latex", rf"latex project public licen[sc]e(?:{V} 1 3c?)?", TITLE),
    ("ofl-1.1", "open font", rf"(?:sil )?open font licen[sc]e(?:{V} 1 1)?", TITLE),
    ("odbl-1.0", "open database", rf"open database licen[sc]e(?:{V} 1(?: 0)?)?", TITLE),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: v?1 0)?", TITLE),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e", TITLE),
    ("cdla-permissive-2.0", "community data", rf"community data licen[sc]e agreement permissive(?:{V} [12] 0)?", TITLE),
    ("cdla-sharing-1.0", "community data", rf"community data licen[sc]e agreement sharing(?:{V} 1 0)?", TITLE),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", TITLE),
    ("cc0-1.0", "creative commons", r"creative commons zero(?: v?1 0)?(?: universal)?", TITLE),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", TITLE + 3),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", TITLE + 3),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", TITLE + 2),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", TITLE + 2),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", TITLE + 2),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", TITLE),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", TITLE + 3),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", TITLE + 3),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", TITLE + 2),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", TITLE + 2),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?", TITLE + 2),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?", TITLE),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?", FAMILY),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: v?2 0)?", TITLE),
    ("sspl-1.0", "server side", rf"server side public licen[sc]e(?:{V} 1)?", TITLE),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", TITLE),
    ("mulan-psl-2.0", "mulan", rf"mulan permissive software licen[sc]e(?:{V} 2)?", TITLE),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", TITLE),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?(?: licen[sc]e)?", TITLE),
    ("polyform-noncommercial", "polyform", r"polyform non ?commercial licen[sc]e(?: 1 0 0)?", TITLE),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e condition)?", TITLE),
    ("jsr-json", "json licen", r"(?:the )?json licen[sc]e", TITLE),
    ("tcl", "tcl", r"tcl tk licen[sc]e", TITLE),
    ("naist", "naist", r"naist 2003 licen[sc]e", TITLE),
    ("qpl-1.0", "q public", rf"q public licen[sc]e(?:{V} 1(?: 0)?)?", TITLE),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", TITLE),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? licen[sc]e", TITLE),
    ("zpl-2.1", "zope", rf"zope public licen[sc]e(?:{V} 2 1)?", TITLE),
)

#: Sentences of full licence texts and of file headers: (label, keyword, pattern)
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("mit", "noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-0", "permit persons", r"sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-style", "in advertising", r"the name of (?:the )?(?:\S+ ){1,6}(?:shall|may) not be used in advertising or (?:otherwise to promote|publicity)"),
    ("curl", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-0-clause", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "disclaims all warranties", r"(?:isc|internet systems consortium|internet software consortium) disclaims all warranties with regard to this software"),
    ("isc", "tortious action", r"resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("bsd", "list of conditions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-1-clause", "list of conditions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided by"),
    ("bsd", "theory of liability", r"however caused and on any theory of liability whether in contract strict liability or tort"),
    ("bsd-3-clause", "without specific prior", r"used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "patent rights", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-3-clause-lbnl", "no obligation whatsoever", r"you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code"),
    ("bsd-2-clause-views", "official policies", r"should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-4-clause", "university of california", r"this product includes software developed by the university of california(?: berkeley and its contributors)?"),
    ("bsd-style-header", "bsd style", r"governed by a bsd style licen[sc]e that can be found in the licen[sc]e file"),
    ("mit-style-header", "mit style", r"governed by an mit style licen[sc]e that can be found in the licen[sc]e file"),
    ("apache-2.0", "licen", r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use"),
    ("apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "contributor licen", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "grant of patent", r"grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants"),
    ("apache-2.0", "notice text file", r"if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "submission of contributions", r"submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for inclusion"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", "apache", r"products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("llvm-exception", "llvm exceptions", r"apache licen[sc]e v?2 0 with llvm exceptions"),
    ("llvm-exception", "embedded", r"if as a result of your compiling your source code portions of this software are embedded into an object form"),
    ("gpl", "fitness for a particular", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    ("gpl-3.0", "version 3", r"general public licen[sc]e version 3 29 june 2007"),
    ("gpl-2.0", "version 2", r"general public licen[sc]e version 2 june 1991"),
    ("gpl-1.0", "version 1", r"general public licen[sc]e version 1 february 1989"),
    ("gpl", "freedom to share", r"the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("gpl-3.0", "installation information", r"installation information for a user product means any methods procedures authorization keys"),
    ("gpl-2.0", "derived from the program", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2.0-only", "version 2", r"under the terms of (?:the )?gnu general public licen[sc]e version 2(?: only)? as published by the free software foundation"),
    ("gpl-3.0-only", "version 3", r"under the terms of (?:the )?gnu general public licen[sc]e version 3(?: only)? as published by the free software foundation"),
    ("gpl-short-header", "gnu org", r"gnu org licen[sc]es(?: old licen[sc]es)? gpl(?: [123] 0)?(?: html| txt)?"),
    ("classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception", "classpath exception", r"(?:with|subject to) the classpath exception"),
    ("gcc-exception-3.1", "runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("bison-exception", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "configure scripts", r"as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts"),
    ("autoconf-exception", "unlimited permission", r"gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved"),
    ("openssl-exception", "openssl", r"permission to link the code of (?:\S+ ){1,8}with the openssl (?:project s )?(?:openssl )?library"),
    ("lgpl-2.1", "version 2 1", r"lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3.0", "additional permissions", r"incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e supplemented by the additional permissions"),
    ("lgpl-2.0", "library general", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation"),
    ("lgpl-2.1-or-later", "version 2 1", r"either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl", "work that uses the library", r"a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library"),
    ("agpl-3.0", "remote network interaction", r"remote network interaction use with the gnu general public licen[sc]e"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("agpl-3.0", "interacting with it remotely", r"must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "obtain one at", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "secondary licen", r"incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-1.1", "alternatively", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public licen[sc]e version 1 [01]"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-1.0", "cddl header", r"when distributing covered code include this cddl header notice in each file"),
    ("epl-1.0", "eclipse", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("epl-1.0", "eclipse org", r"eclipse org legal epl v10 html"),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl 2 0"),
    ("edl-1.0", "eclipse org", r"eclipse org org documents edl v10"),
    ("cpl-1.0", "common public", r"the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("ipl-1.0", "ibm public", r"the accompanying program is provided under the terms of this ibm public licen[sc]e"),
    ("eupl", "eupl", r"licen[sc]ed under the eupl(?: version)? 1 [12] or as soon they will be approved by the european commission"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? licen[sc]e under french law"),
    ("artistic-2.0", "standard version", r"you may distribute verbatim copies of the source form of the standard version of this package"),
    ("artistic-1.0", "standard version", r"you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("perl", "same terms as perl", r"(?:under|on) the same terms as perl(?: itself)?"),
    ("ruby", "verbatim copies", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("psf-2.0", "psf hereby", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e"),
    ("cnri-python", "cnri", r"cnri is making python (?:1 6(?: 1)? )?available to licensee on an as is basis"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("php-3.01", "php licen", r"subject to version 3 01 of the php licen[sc]e that is bundled with this package"),
    ("zlib", "arising from the use", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "modify libpng", r"if you modify libpng you may insert additional notices immediately following this sentence"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright (?:c )?(?:\S+ ){0,2}the freetype project"),
    ("info-zip", "definition disclaimer", r"redistributions of source code in whole or in part must retain the above copyright notice definition disclaimer and this list of conditions"),
    ("bzip2-1.0.6", "acknowledgment", r"if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("openssl", "cryptographic software", r"this product includes cryptographic software written by eric young"),
    ("ssleay", "eric young", r"this package is an ssl implementation written by eric young"),
    ("sleepycat", "accompanying software", r"complete source code for the db software and any accompanying software that uses the db software"),
    ("postgresql", "university of california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("hpnd", "without fee is hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "supporting documentation", r"both the copyright notice and this permission notice appear in supporting documentation and that the name (?:\S+ ){1,8}not be used in advertising"),
    ("tcl", "restricted rights", r"if you are acquiring this software on behalf of the u s government the government shall have only restricted rights"),
    ("vim", "vim", r"you can distribute a modified vim(?: to others)? (?:provided|when)"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "this stuff is worth", r"if we meet some day and you think this stuff is worth it"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("boost-header", "accompanying file", r"distributed under the boost software licen[sc]e version 1 0 see accompanying file"),
    ("bsl-1.0", "boost org", r"boost org licen[sc]e 1 0 txt"),
    ("bsl-1.1", "rights granted", r"change licen[sc]e and the rights granted in the paragraph above terminate"),
    ("bsl-1.1", "production use", r"make non production use of the licensed work"),
    ("sspl-1.0", "third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("polyform", "polyform", r"polyformproject org licen[sc]es (?:non ?commercial|small business|shield|strict|perimeter|internal use)"),
    ("confluent-community", "confluent", r"confluent community licen[sc]e(?: agreement)?(?: version 1 0)?"),
    ("rsal", "redis", r"redis source available licen[sc]e(?: agreement)?(?: 2 0)?"),
    ("timescale", "timescale", r"timescale licen[sc]e(?: agreement)?"),
    ("ofl-1.1", "reserved font", r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ubuntu-font-1.0", "ubuntu font", r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream"),
    ("arphic", "arphic", r"arphic public licen[sc]e"),
    ("lppl", "latex", r"may be distributed and or modified under the conditions of the latex project public licen[sc]e"),
    ("odbl-1.0", "open database", r"made available under the open database licen[sc]e"),
    ("odc-by-1.0", "opendatacommons", r"opendatacommons org licen[sc]es (?:by|odbl|pddl)(?: 1 0)?"),
    ("cc0-1.0", "extent possible under law", r"to the extent possible under law (?:\S+ ){1,8}(?:has|have) (?:waived|dedicated)"),
    ("cc-by", "creative commons", r"this work is licen[sc]ed under a creative commons attribution [1-4] [05] (?:international|unported|generic)? ?licen[sc]e"),
    ("cc-by-sa", "creative commons", r"this work is licen[sc]ed under a creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic)? ?licen[sc]e"),
    ("cc-by-nc", "creative commons", r"this work is licen[sc]ed under a creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic)? ?licen[sc]e"),
    ("wikipedia", "additional terms", r"text is available under the creative commons attribution share ?alike licen[sc]e additional terms may apply"),
    ("gutenberg", "gutenberg", r"under the terms of the project gutenberg licen[sc]e included with this ebook"),
    ("open-government-3.0", "open government", r"contains public sector information licen[sc]ed under the open government licen[sc]e v?3 0"),
    ("etalab-2.0", "etalab", r"licence ouverte(?: open licen[sc]e)?(?: etalab)?(?: version)?(?: 2 0)?"),
    ("us-government-work", "title 17", r"(?:not subject to copyright protection )?(?:pursuant to|under) title 17(?: section 105)? (?:of the )?united states code"),
    ("us-government-work", "work of the united states", r"is a work of the united states government and is (?:in the public domain|not subject to copyright)"),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("ms-pl", "accompanying software", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("ms-eula", "microsoft", r"microsoft software licen[sc]e terms"),
    ("apsl-2.0", "apple", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e"),
    ("apple-sample", "apple", r"in consideration of your agreement to the following terms and your use installation modification or redistribution of this apple software"),
    ("intel-simplified", "intel", r"intel simplified software licen[sc]e"),
    ("nvidia-eula", "nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights"),
    ("oracle-bcl", "oracle", r"oracle binary code licen[sc]e agreement"),
    ("upl-1.0", "larger works", r"the software or larger works? to which the software is contributed by such licensors"),
    ("w3c", "being provided by", r"this work is being provided by the copyright holders under the following licen[sc]e by obtaining and or copying this work you agree"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files"),
    ("icu", "icu licen", r"icu licen[sc]e icu 1 8 1 (?:and later|to icu 57 1)"),
    ("blueoak-1.0.0", "blueoakcouncil", r"blueoakcouncil org licen[sc]e 1 0 0"),
    ("mulan-psl-2.0", "mulan", r"coscl org cn mulanpsl2"),
    ("mulan-psl-2.0", "mulan", r"you can use this software according to the terms and conditions of the mulan psl v2"),
    ("openrail", "use based restrictions", r"use based restrictions set forth in (?:attachment|paragraph) a"),
    ("llama-community", "llama", r"llama (?:[23](?: [0-9])? )?community licen[sc]e agreement"),
    ("cdla-permissive", "community data", r"data provider makes the data available under the community data licen[sc]e agreement"),
    ("proprietary", "trade secret", r"contains (?:confidential|proprietary|valuable)(?: and (?:proprietary|confidential))? (?:information|trade secrets?)(?: of| and)"),
    ("proprietary", "reverse engineer", r"you may not (?:\S+ ){0,6}(?:reverse engineer decompile|decompile reverse engineer|decompile disassemble)"),
    ("proprietary", "end user licen", r"(?:this )?end user licen[sc]e agreement(?: eula)?(?: is a legal agreement)?"),
    ("proprietary", "evaluation", r"for (?:internal )?evaluation purposes only"),
    ("non-commercial", "commercial", r"for (?:personal|academic|research|educational)(?: and| or)? ?(?:personal|academic|research|educational)? ?(?:and |or )?non ?commercial (?:use|purposes?) only"),
    ("source-available", "source available", r"source available licen[sc]e"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance with the licen", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "apache org", r"apache org licenses licen[sc]e 2 0"),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-3.0-or-later", "later version", r"either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0-or-later", "later version", r"either version 2 of the licen[sc]e or at your option any later version"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl-2.0", "eclipse", r"are made available under the terms of the eclipse public licen[sc]e"),
    ("bsl-1.0", "in whole or in part", r"must be included in all copies of the software in whole or in part and all derivative works of the software unless"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("creative-commons", "creativecommons", r"creativecommons org licenses(?: by\S*)?(?: (?:nc|nd|sa))*(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("artistic", "package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", "scripts sil", r"scripts sil org ofl"),
    ("postgresql", "written agreement", r"without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ncsa", "deal with the software", r"deal with the software without restriction"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|in to|into|to) the public domain"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited"),
)

#: Weak signs: (label, keyword, pattern)
MENTIONS: tuple[tuple[str, str, str], ...] = (
    ("copyright", "all rights reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("unknown-license", "licen", r"(?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of )?(?:an? |the )?licen[sc]e"),
    ("warranty-disclaimer", "warrant", r"without warranty of any kind"),
    ("warranty-disclaimer", "warrant", r"provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    ("public-domain", "public domain", r"public domain"),
)

GRANT_WORDS = r"(?:(?:dual )?licen[sc]ed|released|distributed|available|provided|published|offered|shared|covered) (?:(?:for use )?under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the |an? )?)?(?:an? )?"


def _rules() -> tuple[Rule, ...]:
    found: list[Rule] = []

    def add(name: str, label: str, priority: int, keyword: str, pattern: str) -> None:
        found.append(Rule(name, label, priority, (keyword,), re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")))

    for i, (label, keyword, pattern) in enumerate(NOTICES):
        add(f"notice-{i}", label, NOTICE, keyword, pattern)
    for i, (label, keyword, pattern, rank) in enumerate(TITLES):
        add(f"grant-{i}", label, GRANT + rank % 10 - (rank < TITLE) * 5, keyword, GRANT_WORDS + pattern)
        add(f"title-{i}", label, rank, keyword, pattern)
    for label in sorted({t[0] for t in TITLES}):
        add(f"identifier-{label}", label, IDENTIFIER, "spdx", rf"spdx licen[sc]e identifier {re.sub(r'[^0-9a-z]+', ' ', label)}(?: only)?")
    for i, (label, keyword, pattern) in enumerate(MENTIONS):
        add(f"mention-{i}", label, MENTION, keyword, pattern)
    return tuple(sorted(found, key=lambda r: (-r.priority, r.name)))


RULES = _rules()
