"""The signature rules of the license scan, best first within a confidence.

One rule a line: label | confidence | keywords | pattern. Patterns match words of a lower-cased text between single
spaces; of a rule's keywords every match holds one, as a word of its own. U, V and L stand for ways to say "licensed
under the terms of", for a version, and for "license". Names that also mean something else (a school, a language, a
league) need more than "released under": "license" or a version behind them, "licensed" before them (G), or that the
sentence goes on without a noun (E), as "released under MIT supervision" names no license.
"""

from __future__ import annotations

MACROS = {
    "{U}": "(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered|shipped) under (?:the |an |a )?(?:terms (?:and conditions )?of (?:the |either the )?)?",
    "{G}": "licen[sc]ed under (?:the |an |a )?(?:terms (?:and conditions )?of (?:the |either the )?)?",
    "{E}": "(?= (?:$|(?:and|or|but|with|by|see|for|at|in|on|if|so|as|it|is|this|the|you|we|please|copyright|all|http|https|www) ))",
    "{R}": " (?:version |v )?v?[0-9]+(?: [0-9]+)?",
    "{V}": "(?: (?:version |v )?v?[0-9]+(?: [0-9]+)?)?",
    "{L}": "licen[sc]e",
}

RULES = """
mit | 1.0 | spdx | spdx {L} identifier mit
mit | 0.95 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.9 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0.9 | merge | without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 0.9 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.9 | mit | {U}mit(?: x11)? {L}|{G}mit(?: x11)?|{U}mit(?: x11)?{E}
mit | 0.85 | opensource | opensource org licenses mit(?: {L})?(?: php)?
mit | 0.8 | mit | mit x11 {L}|mit expat {L}|expat mit {L}
mit | 0.8 | expat | {U}expat {L}|the expat {L}
mit | 0.7 | mit | {L} mit|mit licen[sc]ed
mit | 0.6 | mit | mit {L}s?
apache | 1.0 | spdx | spdx {L} identifier apache 2 0
apache | 0.95 | apache | licen[sc]ed under the apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}
apache | 0.9 | apache | www apache org licenses(?: {L} 2 0)?
apache | 0.9 | apache | licen[sc]ed to the apache software foundation asf under one or more contributor {L} agreements
apache | 0.9 | apache | {U}apache(?: software)?(?: foundation)?(?: {L}{V}|{R})|{G}apache(?: software)?(?: foundation)?|{U}apache{E}
apache | 0.85 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {L}
apache | 0.85 | apache | apache(?: software)? {L} (?:version |v )?v?[12](?: [01])?
apache | 0.8 | asl | {U}asl 2 0
apache | 0.7 | apache | {L} apache(?: 2 0)?|apache 2 0 licen[sc]ed
apache | 0.6 | apache | apache(?: software)? {L}s?
gpl | 1.0 | spdx | spdx {L} identifier gpl [123] 0(?: only| or later)?
gpl | 0.95 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu general public {L}
gpl | 0.95 | redistribute | is free software you can redistribute it and or modify it under the terms of (?:the )?gpl
gpl | 0.85 | redistribute | this (?:program|library|software|package|file) is free software you can redistribute it and or modify it(?! under the terms of the gnu)
gpl | 0.9 | received | you should have received a copy of the gnu general public {L}
gpl | 0.85 | copyleft | the gnu general public {L} is a free copyleft {L}
gpl | 0.85 | preamble | gnu general public {L} version [123](?: [a-z0-9]+){0,8} preamble
gpl | 0.9 | gpl|gplv1|gplv2|gplv3|gplv2+|gplv3+ | {U}(?:gnu )?gpl(?:v[123])?{V}(?: or later)?
gpl | 0.9 | general | {U}(?:gnu )?general public {L}{V}
gpl | 0.85 | gnu | www gnu org licenses gpl(?: [123] 0)?|www gnu org copyleft gpl
gpl | 0.8 | general | gnu general public {L}{V}
gpl | 0.75 | gplv1|gplv2|gplv3 | gplv[123]
gpl | 0.7 | gpl | gnu gpl{V}|gpl {L}|{L} gpl|gpl version [123]|gpl v[123]|gpl [123] 0
gpl | 0.6 | general | general public {L}
lgpl | 1.0 | spdx | spdx {L} identifier lgpl [23] [01](?: only| or later)?
lgpl | 0.95 | lesser|library | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {L}
lgpl | 0.9 | received | you should have received a copy of the gnu (?:lesser|library) general public {L}
lgpl | 0.9 | lgpl|lgplv2|lgplv3 | {U}(?:gnu )?lgpl(?:v[23])?{V}(?: or later)?
lgpl | 0.9 | lesser|library | {U}(?:gnu )?(?:lesser|library) (?:general public {L}|gpl){V}
lgpl | 0.85 | gnu | www gnu org licenses lgpl(?: [23] [01])?
lgpl | 0.8 | lesser|library | (?:gnu )?(?:lesser|library) general public {L}{V}
lgpl | 0.75 | lgplv2|lgplv3 | lgplv[23]
lgpl | 0.7 | lgpl | gnu lgpl{V}|lgpl {L}|{L} lgpl|lgpl version [23]|lgpl [23] [01]
agpl | 1.0 | spdx | spdx {L} identifier agpl 3 0(?: only| or later)?
agpl | 0.95 | affero | free software you can redistribute it and or modify it under the terms of the gnu affero general public {L}
agpl | 0.9 | received | you should have received a copy of the gnu affero general public {L}
agpl | 0.9 | agpl|agplv3 | {U}(?:gnu )?agpl(?:v3)?{V}(?: or later)?
agpl | 0.9 | affero | {U}(?:gnu )?affero (?:general public {L}|gpl){V}
agpl | 0.85 | gnu | www gnu org licenses agpl(?: 3 0)?
agpl | 0.8 | affero | (?:gnu )?affero general public {L}{V}
agpl | 0.75 | agplv3 | agplv3
agpl | 0.7 | agpl | gnu agpl{V}|agpl {L}|{L} agpl|agpl version 3|agpl 3 0
gfdl | 1.0 | spdx | spdx {L} identifier gfdl 1 [123](?: only| or later)?
gfdl | 0.95 | invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}(?: [a-z0-9]+){0,16} invariant sections
gfdl | 0.9 | documentation | {U}(?:gnu )?free documentation {L}{V}
gfdl | 0.8 | documentation | gnu free documentation {L}{V}
gfdl | 0.7 | gfdl | gnu gfdl|gfdl {L}|{L} gfdl|{U}gfdl{V}
bsd | 1.0 | spdx | spdx {L} identifier (?:0bsd|bsd [1234] clause(?: [a-z]+)?)
bsd | 0.95 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.9 | redistribution | redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?
bsd | 0.9 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 0.85 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 0.85 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 0.85 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd | 0.85 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 0.9 | bsd | {U}(?:(?:[0234]|two|three|four|zero) clause )?(?:new |modified |simplified |revised |original )?bsd(?: (?:[0234]|two|three|four|zero) clause)?(?: style)?(?: {L})?
bsd | 0.85 | opensource | opensource org licenses bsd(?: [23] clause| {L})?
bsd | 0.8 | bsd | (?:[0234]|two|three|four|zero) clause bsd(?: {L})?|bsd (?:[0234]|two|three|four|zero) clause(?: {L})?
bsd | 0.75 | bsd | (?:new|modified|simplified|revised|original) bsd {L}
bsd | 0.7 | bsd | {L} bsd|bsd licen[sc]ed|bsd style {L}
bsd | 0.6 | bsd | bsd {L}s?
mpl | 1.0 | spdx | spdx {L} identifier mpl [12] [01]
mpl | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public {L}{V}
mpl | 0.95 | mozilla | the contents of this file are subject to the mozilla public {L}{V}
mpl | 0.9 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl | 0.9 | mozilla | (?:www )?mozilla org mpl(?: [12] [01])?
mpl | 0.9 | mozilla | {U}mozilla public {L}{V}
mpl | 0.9 | mpl | {U}mpl(?:{V} {L}|{R})|{G}mpl|{U}mpl{E}
mpl | 0.8 | mozilla | mozilla public {L}{V}
mpl | 0.7 | mpl | mpl {L}|mpl version [12]|mpl [12] [01]
epl | 1.0 | spdx | spdx {L} identifier epl [12] 0
epl | 0.95 | eclipse | (?:this program and the )?accompanying materials are made available under the terms of the eclipse public {L}{V}
epl | 0.9 | eclipse | (?:www )?eclipse org (?:legal|org documents) epl(?: v[12][0-9]*)?
epl | 0.9 | eclipse | {U}eclipse (?:public|distribution) {L}{V}
epl | 0.8 | eclipse | eclipse (?:public|distribution) {L}{V}
epl | 0.8 | epl | {U}epl(?: {L}|{R})|{G}epl|{U}epl{E}
epl | 0.7 | epl | epl {L}|epl v?[12](?: 0)?
cddl | 1.0 | spdx | spdx {L} identifier cddl 1 [01]
cddl | 0.95 | cddl | the contents of this file are subject to the terms of (?:either the gnu general public {L}(?: [a-z0-9]+){0,10} or )?the common development and distribution {L}(?: [a-z0-9]+){0,4} cddl
cddl | 0.9 | development | {U}common development and distribution {L}{V}
cddl | 0.8 | development | common development and distribution {L}{V}
cddl | 0.8 | cddl | {U}cddl{V}|cddl {L}|cddl 1 [01]
cpl | 0.9 | common | {U}common public {L}{V}
cpl | 0.8 | common | common public {L}{V}
cpal | 0.9 | attribution | common public attribution {L}{V}|{U}common public attribution {L}{V}
isc | 1.0 | spdx | spdx {L} identifier isc
isc | 0.95 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | isc | {U}isc {L}|{G}isc|{U}isc{E}
isc | 0.7 | isc | {L} isc|isc licen[sc]ed
isc | 0.6 | isc | isc {L}
zlib | 1.0 | spdx | spdx {L} identifier zlib(?: acknowledgement)?
zlib | 0.95 | permission | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | 0.9 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.9 | altered | altered source versions must be plainly marked as such
zlib | 0.9 | zlib | {U}zlib(?: libpng)? {L}|{G}zlib(?: libpng)?|{U}zlib(?: libpng)?{E}
zlib | 0.7 | zlib | zlib libpng {L}|{L} zlib
zlib | 0.6 | zlib | zlib {L}
libpng | 0.8 | libpng | {U}libpng {L}|libpng {L}{V}
boost | 1.0 | spdx | spdx {L} identifier bsl 1 0
boost | 0.95 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost | 0.9 | boost | distributed under the boost software {L}{V}
boost | 0.9 | boost | www boost org {L} 1 0
boost | 0.9 | boost | {U}boost(?: software)? {L}{V}|{G}boost{R}
boost | 0.7 | boost | boost(?: software)? {L}{V}
bsl | 0.95 | business | business source {L}{V}
bsl | 0.9 | busl | spdx {L} identifier busl 1 1|{U}busl 1 1
sspl | 0.95 | server | server side public {L}{V}
sspl | 0.8 | sspl | {U}sspl{V}|sspl {L}|spdx {L} identifier sspl 1 0
elastic | 0.9 | elastic | {U}elastic {L}{V}|elastic {L} (?:version )?v?2(?: 0)?
artistic | 1.0 | spdx | spdx {L} identifier artistic [12] 0(?: [a-z0-9]+)?
artistic | 0.95 | perl | you can redistribute it and or modify it under the same terms as perl itself
artistic | 0.9 | artistic | {U}(?:perl )?artistic(?: {L}{V}|{R})
artistic | 0.8 | artistic | (?:perl )?artistic {L}{V}
python | 1.0 | spdx | spdx {L} identifier (?:python 2 0|psf 2 0)
python | 0.95 | python | this {L} agreement is between the python software foundation psf
python | 0.9 | python|psf | {U}(?:python(?: software foundation)?|psf) {L}{V}|{G}psf{V}
python | 0.7 | python | python software foundation {L}
python | 0.7 | psf | psf {L}
postgresql | 1.0 | spdx | spdx {L} identifier postgresql
postgresql | 0.95 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql | 0.9 | postgresql | {U}postgresql {L}
postgresql | 0.6 | postgresql | postgresql {L}
hpnd | 0.85 | permission | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
ncsa | 1.0 | spdx | spdx {L} identifier ncsa
ncsa | 0.9 | illinois | university of illinois (?:ncsa )?open source {L}
ncsa | 0.8 | ncsa | {U}ncsa {L}|ncsa open source {L}|illinois ncsa {L}
openssl | 1.0 | spdx | spdx {L} identifier openssl
openssl | 0.9 | openssl | this product includes software developed by the openssl project
openssl | 0.8 | openssl | {U}openssl {L}|openssl {L}
php | 0.9 | php | this source file is subject to version [23] [0-9]+ of the php {L}
php | 0.8 | php | {U}php {L}{V}|php {L} (?:version |v )?v?3(?: [0-9]+)?
ruby | 0.8 | ruby | {U}ruby {L}|same terms as ruby(?: itself)?
vim | 0.8 | vim | {U}vim {L}|vim {L}
curl | 0.8 | curl | {U}curl {L}|curl {L}
tcl | 0.8 | tcl | {U}tcl tk {L}|tcl tk {L}
x11 | 0.8 | x11|consortium | {U}x11 {L}|x11 {L}|x consortium {L}|spdx {L} identifier x11
w3c | 0.85 | w3c | w3c software (?:notice and |and document )?(?:notice and )?{L}|{U}w3c {L}
unicode | 0.85 | unicode | unicode {L} (?:agreement|v3)|{U}unicode {L}
intel | 0.8 | intel | intel (?:simplified software|open source) {L}
eupl | 1.0 | spdx | spdx {L} identifier eupl 1 [012]
eupl | 0.95 | eupl | {U}(?:the )?eupl{V}
eupl | 0.9 | european | {U}european union public licen[sc]e{V}
eupl | 0.8 | european | european union public licen[sc]e{V}
eupl | 0.7 | eupl | eupl licen[sc]e|eupl v?1(?: [012])?
cecill | 0.9 | cecill | {U}cecill(?: [abc2])?(?: {L})?|cecill (?:free software )?{L}
ms-pl | 0.9 | microsoft | {U}microsoft public {L}|microsoft public {L}
ms-pl | 0.7 | pl | ms pl {L}|{U}ms pl
ms-rl | 0.9 | reciprocal | microsoft reciprocal {L}
osl | 0.9 | open | {U}open software {L}{V}|licen[sc]ed under the open software {L}{V}
afl | 0.9 | academic | {U}academic free {L}{V}|academic free {L}{V}
qpl | 0.8 | qpl|q | {U}qpl{V}|q public {L}
sleepycat | 0.8 | sleepycat | {U}sleepycat {L}|sleepycat {L}
beerware | 0.95 | beer|beerware | beer ?ware {L}|if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware | 0.8 | beerware | beerware {L}|{U}beerware
wtfpl | 1.0 | spdx | spdx {L} identifier wtfpl
wtfpl | 0.95 | fuck | do what the fuck you want to public {L}
wtfpl | 0.9 | fuck | you just do what the fuck you want to
wtfpl | 0.8 | wtfpl | {U}wtfpl{V}|wtfpl {L}|{L} wtfpl
unlicense | 1.0 | spdx | spdx {L} identifier unlicen[sc]e
unlicense | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 0.9 | copy | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 0.8 | unlicense|unlicence | {U}unlicen[sc]e|the unlicen[sc]e|unlicen[sc]e org
public-domain | 0.9 | domain | (?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain
public-domain | 0.8 | domain | this (?:work|file|software|code|text|image|document) is in the public domain
public-domain | 0.8 | domain | has (?:waived all copyright|dedicated the work to the public domain)(?: [a-z0-9]+){0,12} public domain
cc0 | 1.0 | spdx | spdx {L} identifier cc0 1 0
cc0 | 0.95 | cc0 | cc0 1 0 universal
cc0 | 0.9 | creative|publicdomain | creative commons (?:cc0|zero|public domain dedication)(?: {L})?|publicdomain zero 1 0
cc0 | 0.9 | cc0 | {U}cc0{V}|creative commons cc0(?: {L})?
cc0 | 0.7 | cc0 | cc0 {L}|{L} cc0
cc-by-nc-sa | 1.0 | spdx | spdx {L} identifier cc by nc sa [1234] [05]
cc-by-nc-sa | 0.95 | creative | creative commons attribution non ?commercial share ?alike(?: {L})?{V}
cc-by-nc-sa | 0.9 | cc | {U}cc by nc sa{V}
cc-by-nc-sa | 0.85 | creativecommons | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-sa | 0.8 | cc | cc by nc sa{V}
cc-by-nc-nd | 1.0 | spdx | spdx {L} identifier cc by nc nd [1234] [05]
cc-by-nc-nd | 0.95 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: {L})?{V}
cc-by-nc-nd | 0.9 | cc | {U}cc by nc nd{V}
cc-by-nc-nd | 0.85 | creativecommons | creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc-nd | 0.8 | cc | cc by nc nd{V}
cc-by-nc | 1.0 | spdx | spdx {L} identifier cc by nc [1234] [05]
cc-by-nc | 0.93 | creative | creative commons attribution non ?commercial(?: {L})?{V}
cc-by-nc | 0.88 | cc | {U}cc by nc{V}
cc-by-nc | 0.83 | creativecommons | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nc | 0.78 | cc | cc by nc{V}
cc-by-sa | 1.0 | spdx | spdx {L} identifier cc by sa [1234] [05]
cc-by-sa | 0.95 | creative | creative commons attribution share ?alike(?: {L})?{V}
cc-by-sa | 0.9 | cc | {U}cc by sa{V}
cc-by-sa | 0.85 | creativecommons | creativecommons org licenses by sa(?: [1234] [05])?
cc-by-sa | 0.8 | cc | cc by sa{V}
cc-by-nd | 1.0 | spdx | spdx {L} identifier cc by nd [1234] [05]
cc-by-nd | 0.95 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: {L})?{V}
cc-by-nd | 0.9 | cc | {U}cc by nd{V}
cc-by-nd | 0.85 | creativecommons | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-nd | 0.8 | cc | cc by nd{V}
cc-by | 1.0 | spdx | spdx {L} identifier cc by [1234] [05]
cc-by | 0.9 | creative | creative commons attribution(?: {L})?{V}(?: international| unported| generic)?
cc-by | 0.85 | cc | {U}cc by{V}
cc-by | 0.8 | creativecommons | creativecommons org licenses by(?: [1234] [05])?
cc-by | 0.7 | cc | cc by (?:{L}|[1234] [05])
cc | 0.6 | creative | {U}creative commons(?: {L})?|creative commons {L}s?
ofl | 1.0 | spdx | spdx {L} identifier ofl 1 [01](?: [a-z]+)?
ofl | 0.95 | font | this font software is licen[sc]ed under the sil open font {L}{V}
ofl | 0.9 | font | {U}(?:sil )?open font {L}{V}
ofl | 0.9 | ofl | scripts sil org ofl|{U}(?:sil )?ofl{V}
ofl | 0.8 | font | (?:sil )?open font {L}{V}
odbl | 1.0 | spdx | spdx {L} identifier odbl 1 0
odbl | 0.9 | database | {U}(?:odc )?open database {L}{V}|open data commons open database {L}
odbl | 0.8 | database | open database {L}{V}
odbl | 0.8 | odbl | {U}odbl{V}|odbl {L}
odc-by | 0.9 | attribution | open data commons attribution {L}{V}
pddl | 0.9 | pddl|dedication | open data commons public domain dedication and {L}|{U}pddl{V}
ogl | 0.9 | government | {U}open government licen[sc]e{V}|open government licen[sc]e{V}
llama | 0.9 | llama | llama (?:[234](?: [0-9])? )?community {L}(?: agreement)?
rail | 0.9 | rail|openrail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: {L})?
proprietary | 0.95 | unauthorized|unauthorised | unauthori[sz]ed copying of this (?:file|software|document|work) via any medium is strictly prohibited
proprietary | 0.9 | proprietary | proprietary and confidential
proprietary | 0.85 | proprietary | this (?:software|program|file|document|code) is proprietary|{U}proprietary {L}|proprietary software {L}
proprietary | 0.85 | agreement | end user {L} agreement
proprietary | 0.85 | eula | {U}eula|subject to (?:the |this )?eula
proprietary | 0.8 | commercial | {U}commercial {L}|commercial {L} agreement
proprietary | 0.8 | trade | contains trade secrets(?: and (?:confidential|proprietary) information)?
proprietary | 0.8 | reproduced | no part of this (?:publication|book|work|document) may be reproduced
noncommercial | 0.9 | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|free trial) {L}{V}
noncommercial | 0.8 | noncommercial|commercial | for non ?commercial (?:use|purposes|research) only
"""


def table() -> list[tuple[str, float, tuple[str, ...], str]]:
    """Rules (label, confidence, keywords, pattern), in the order of their priority: the surer first."""
    rows = []
    for line in RULES.strip().splitlines():
        label, confidence, rest = (x.strip() for x in line.split(" | ", 2))
        keywords, pattern = (x.strip() for x in rest.split(" | ", 1))
        for name, meaning in MACROS.items():
            pattern = pattern.replace(name, meaning)
        rows.append((label, float(confidence), tuple(keywords.split("|")), pattern))
    return sorted(rows, key=lambda x: -x[1])
