"""Hand-written license signatures.

One rule per line: ``label | kind | keyword | pattern``.  Patterns are regular
expressions over a text's words (lower-case runs of ASCII letters, digits and
non-ASCII characters), written with one space between words; punctuation between
words does not matter, so ``gpl 2 0`` stands for ``GPL-2.0``.  The keyword is one
whole word that every match of the pattern contains; a rule is tried only on
texts that hold its keyword.  Constructs are limited to those that mean the same
in Java and RE2 (no look-around, no back references).

Kinds, in falling priority: ``id`` machine-readable tags, ``text`` sentences of a
license, ``url`` its address, ``name`` its name, ``ref`` loose mentions.
"""

from __future__ import annotations

from dataclasses import dataclass

#: kind -> (priority, confidence); a smaller priority wins.
KINDS = {"id": (1, 1.0), "text": (2, 0.97), "url": (3, 0.95), "name": (4, 0.9), "ref": (5, 0.5)}

#: Phrases that always count, with their label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_RULES = r"""
apache-2.0 | id | apache | spdx license identifier apache 2 0
apache-2.0 | name | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 | name | apache | apache licen[sc]e (?:version )?v2(?: 0)?
apache-2.0 | url | apache | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | text | apache | licensed under the apache licen[sc]e version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | name | asl | asl (?:version )?2(?: 0)?
apache-2.0 | name | apache | apache 2 0(?: licen[sc]ed?)?
apache-2.0 | name | apache2 | (?:the )?apache2 licen[sc]e
apache-1.1 | id | apache | spdx license identifier apache 1 1
apache-1.1 | name | apache | apache (?:software )?licen[sc]e (?:version )?1 1
apache-1.1 | url | apache | apache org licenses license 1 1
apache-1.0 | id | apache | spdx license identifier apache 1 0
apache-1.0 | name | apache | apache (?:software )?licen[sc]e (?:version )?1 0
apache | ref | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache licen[sc]e
mit | id | mit | spdx license identifier mit
mit | name | mit | (?:the )?mit licen[sc]e
mit | name | mit | mit style licen[sc]e
mit | url | mit | opensource org licenses mit(?: license)?(?: php| html)?
mit | url | mit | choosealicense com licenses mit
mit | ref | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
mit | ref | mit | licen[sc]e mit
mit | text | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | text | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | name | expat | (?:the )?expat licen[sc]e
mit-0 | id | mit | spdx license identifier mit 0
mit-0 | name | mit | mit no attribution(?: licen[sc]e)?
x11 | id | x11 | spdx license identifier x11
x11 | name | x11 | (?:the )?x11 licen[sc]e
x11 | text | consortium | the name of the x consortium shall not be used in advertising
isc | id | isc | spdx license identifier isc
isc | name | isc | (?:the )?isc licen[sc]e
isc | url | isc | opensource org licenses isc(?: license)?(?: txt)?
isc | text | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | id | bsd | spdx license identifier bsd 2 clause(?: freebsd| netbsd)?
bsd-2-clause | name | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[sc]e
bsd-2-clause | name | bsd | bsd (?:2|two) clause(?: (?:simplified )?licen[sc]e)?
bsd-2-clause | name | freebsd | (?:the )?freebsd licen[sc]e
bsd-2-clause | url | bsd | opensource org licenses bsd 2 clause
bsd-3-clause | id | bsd | spdx license identifier bsd 3 clause
bsd-3-clause | name | bsd | (?:new|revised|modified|3 clause|three clause) bsd(?: style)? licen[sc]e
bsd-3-clause | name | bsd | bsd (?:3|three) clause(?: (?:new|revised|clear))?(?: licen[sc]e)?
bsd-3-clause | url | bsd | opensource org licenses bsd 3 clause
bsd-3-clause | text | endorse | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
bsd-3-clause-clear | id | bsd | spdx license identifier bsd 3 clause clear
bsd-3-clause-clear | name | bsd | (?:the )?clear bsd licen[sc]e
bsd-4-clause | id | bsd | spdx license identifier bsd 4 clause(?: uc)?
bsd-4-clause | name | bsd | (?:original|old|4 clause|four clause) bsd licen[sc]e
bsd-4-clause | text | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
0bsd | id | 0bsd | spdx license identifier 0bsd
0bsd | name | bsd | (?:zero clause|0 clause) bsd(?: licen[sc]e)?
0bsd | name | bsd | bsd (?:zero|0) clause licen[sc]e
bsd | text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | text | redistributions | redistributions of source code must retain the above copyright notice
bsd | text | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | name | bsd | (?:the )?bsd(?: style)? licen[sc]e
bsd | ref | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd
bsd | url | bsd | opensource org licenses bsd license(?: php)?
gpl-1.0 | id | gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1.0 | name | gpl | gpl (?:version |v )?1(?: 0)?
gpl-1.0 | name | general | (?:gnu )?general public licen[sc]e (?:version |v )?1(?: 0)?
gpl-2.0-only | id | gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | id | gpl | spdx license identifier gpl 2 0 or later
gpl-2.0 | name | general | (?:the )?(?:gnu )?general public licen[sc]e (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v )2(?: 0)?
gpl-2.0 | name | gpl | (?:gnu )?gpl (?:licen[sc]e )?(?:version |v )?2(?: 0)?
gpl-2.0 | name | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-2.0 | name | gpl2 | (?:gnu )?gpl2
gpl-2.0 | url | gpl | gnu org (?:old )?licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl-2.0-or-later | text | version | either version 2 of the license or at your option any later version
gpl-2.0-or-later | name | gpl | gpl (?:version |v )?2(?: 0)? or (?:any )?later(?: version)?
gpl-2.0-or-later | name | general | general public licen[sc]e (?:version |v )2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later | name | gplv2 | gplv2 or (?:any )?later(?: version)?
gpl-3.0-only | id | gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | id | gpl | spdx license identifier gpl 3 0 or later
gpl-3.0 | name | general | (?:the )?(?:gnu )?general public licen[sc]e (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v )3(?: 0)?
gpl-3.0 | name | gpl | (?:gnu )?gpl (?:licen[sc]e )?(?:version |v )?3(?: 0)?
gpl-3.0 | name | gplv3 | (?:gnu )?gplv3(?: 0)?
gpl-3.0 | name | gpl3 | (?:gnu )?gpl3
gpl-3.0 | url | gpl | gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-3.0-or-later | text | version | either version 3 of the license or at your option any later version
gpl-3.0-or-later | name | gpl | gpl (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later | name | general | general public licen[sc]e (?:version |v )3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later | name | gplv3 | gplv3 or (?:any )?later(?: version)?
gpl | name | general | (?:the )?(?:gnu )?general public licen[sc]e(?: gpl)?
gpl | name | gnu | (?:the )?gnu gpl
gpl | name | gpl | (?:the )?gpl licen[sc]e
gpl | url | gpl | gnu org (?:copyleft|licenses) gpl(?: html| txt| en html)?
gpl | url | gpl | opensource org licenses gpl license(?: php)?
gpl | ref | gpl | (?:licensed|released|distributed|available|covered) (?:under|by) (?:the )?(?:terms of the )?gpl
gpl | text | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | text | received | you should have received a copy of the gnu general public licen[sc]e along with this (?:program|file|software|library)
lgpl-2.0 | id | lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | name | library | (?:gnu )?library general public licen[sc]e(?: (?:version |v )2(?: 0)?)?
lgpl-2.0 | name | lgpl | lgpl (?:version |v )?2(?: 0)?
lgpl-2.1 | id | lgpl | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | id | lgpl | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | name | lesser | (?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl (?:version |v )?2 1
lgpl-2.1 | name | lgplv2 | lgplv2(?: 1)?
lgpl-2.1 | url | lgpl | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
lgpl-3.0 | id | lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | name | lesser | (?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-3.0 | name | lgpl | (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-3.0 | name | lgplv3 | lgplv3(?: 0)?
lgpl-3.0 | url | lgpl | gnu org licenses lgpl 3 0(?: html| txt| en html)?
lgpl | name | lesser | (?:the )?(?:gnu )?lesser general public licen[sc]e(?: lgpl)?
lgpl | name | gnu | (?:the )?gnu lgpl
lgpl | url | lgpl | gnu org licenses lgpl(?: html| txt| en html)?
lgpl | url | lesser | gnu org copyleft lesser(?: html)?
lgpl | ref | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?lgpl
agpl-1.0 | id | agpl | spdx license identifier agpl 1 0(?: only| or later)?
agpl-1.0 | name | affero | affero general public licen[sc]e (?:version |v )?1(?: 0)?
agpl-3.0 | id | agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | name | affero | (?:the )?(?:gnu )?affero general public licen[sc]e (?:agpl )?(?:version |v )?3(?: 0)?
agpl-3.0 | name | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3.0 | name | agplv3 | agplv3(?: 0)?
agpl-3.0 | url | agpl | gnu org licenses agpl 3 0(?: html| txt| en html)?
agpl | name | affero | (?:the )?(?:gnu )?affero (?:general public licen[sc]e|gpl)
agpl | ref | agpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?agpl
gfdl | name | documentation | (?:the )?(?:gnu )?free documentation licen[sc]e(?: gfdl)?(?: (?:version |v )?1 [1-3])?
gfdl | id | gfdl | spdx license identifier gfdl 1 [1-3](?: only| or later| invariants only| no invariants only)?
gfdl | name | gnu | gnu fdl(?: 1 [1-3])?
gfdl | url | fdl | gnu org (?:copyleft|licenses) fdl(?: 1 [1-3])?(?: html| txt)?
mpl-1.0 | id | mpl | spdx license identifier mpl 1 0
mpl-1.0 | name | mozilla | mozilla public licen[sc]e (?:version |v )?1 0
mpl-1.1 | id | mpl | spdx license identifier mpl 1 1
mpl-1.1 | name | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.1 | name | mpl | mpl (?:version |v )?1 1
mpl-1.1 | url | mpl | mozilla org mpl mpl 1 1(?: html| txt)?
mpl-2.0 | id | mpl | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2.0 | name | mozilla | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-2.0 | name | mpl | mpl (?:version |v )?2(?: 0)?
mpl-2.0 | url | mpl | mozilla org mpl 2 0
mpl-2.0 | text | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl | name | mozilla | (?:the )?mozilla public licen[sc]e(?: mpl)?
npl-1.1 | id | npl | spdx license identifier npl 1 [01]
npl-1.1 | name | netscape | netscape public licen[sc]e(?: (?:version |v )?1 [01])?
epl-1.0 | id | epl | spdx license identifier epl 1 0
epl-1.0 | name | eclipse | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-1.0 | url | epl | eclipse org legal epl v10(?: html)?
epl-2.0 | id | epl | spdx license identifier epl 2 0
epl-2.0 | name | eclipse | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-2.0 | url | epl | eclipse org legal epl (?:2 0|v20)(?: html)?
epl | name | eclipse | (?:the )?eclipse public licen[sc]e(?: epl)?
edl-1.0 | name | eclipse | eclipse distribution licen[sc]e(?: (?:version |v )?1 0)?
edl-1.0 | url | edl | eclipse org org documents edl v10(?: html| php)?
cpl-1.0 | id | cpl | spdx license identifier cpl 1 0
cpl-1.0 | name | common | common public licen[sc]e(?: (?:version |v )?1 0)?
ipl-1.0 | id | ipl | spdx license identifier ipl 1 0
ipl-1.0 | name | ibm | ibm public licen[sc]e(?: (?:version |v )?1 0)?
cddl-1.0 | id | cddl | spdx license identifier cddl 1 0
cddl-1.0 | name | cddl | cddl (?:version |v )?1 0
cddl-1.1 | id | cddl | spdx license identifier cddl 1 1
cddl-1.1 | name | cddl | cddl (?:version |v )?1 1
cddl | name | common | (?:the )?common development and distribution licen[sc]e(?: cddl)?(?: (?:version |v )?1 [01])?
spl-1.0 | name | sun | sun public licen[sc]e(?: (?:version |v )?1 0)?
sissl | name | sun | sun industry standards source licen[sc]e
artistic-1.0 | id | artistic | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1.0 | name | artistic | artistic licen[sc]e (?:version |v )?1 0
artistic-2.0 | id | artistic | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic | name | artistic | (?:the )?(?:clarified )?artistic licen[sc]e
artistic | url | artistic | opensource org licenses artistic license(?: 1 0| 2 0)?(?: php)?
perl | ref | perl | under the same terms as perl(?: itself)?
perl | text | perl | you can redistribute it and or modify it under the same terms as (?:the )?perl (?:5 )?(?:programming language system )?itself
python-2.0 | id | python | spdx license identifier python 2 0(?: 1)?
python-2.0 | name | python | (?:the )?python software foundation licen[sc]e(?: (?:version |v )?2)?
python-2.0 | name | psf | psf licen[sc]e(?: agreement)?(?: (?:version |v )?2)?
python-2.0 | id | psf | spdx license identifier psf 2 0
python-2.0 | name | python | (?:the )?python licen[sc]e
php-3.01 | id | php | spdx license identifier php 3 0(?:1)?
php-3.01 | name | php | (?:the )?php licen[sc]e(?: (?:version |v )?3 0(?:1)?)?
php-3.01 | url | php | php net license 3 0(?:1)?(?: txt)?
ruby | id | ruby | spdx license identifier ruby
ruby | name | ruby | (?:the )?ruby licen[sc]e
ruby | ref | ruby | (?:under )?the same (?:terms|licen[sc]e) as ruby
zlib | id | zlib | spdx license identifier zlib(?: acknowledgement)?
zlib | name | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
zlib | text | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | misrepresented | the origin of this software must not be misrepresented
libpng | id | libpng | spdx license identifier libpng(?: 2 0)?
libpng | name | libpng | (?:the )?libpng licen[sc]e
libtiff | id | libtiff | spdx license identifier libtiff
libtiff | name | libtiff | (?:the )?libtiff licen[sc]e
ijg | id | ijg | spdx license identifier ijg
ijg | name | jpeg | independent jpeg group licen[sc]e
ijg | text | jpeg | this software is based in part on the work of the independent jpeg group
curl | id | curl | spdx license identifier curl
curl | name | curl | (?:the )?curl licen[sc]e
openssl | id | openssl | spdx license identifier openssl
openssl | name | openssl | (?:the )?openssl licen[sc]e
openssl | text | openssl | this product includes software developed by the openssl project
ssleay | name | ssleay | (?:the )?(?:original )?ssleay licen[sc]e
bsl-1.0 | id | bsl | spdx license identifier bsl 1 0
bsl-1.0 | name | boost | (?:the )?boost software licen[sc]e(?: (?:version |v )?1 0)?
bsl-1.0 | url | boost | boost org license 1 0(?: txt)?
unlicense | id | unlicense | spdx license identifier unlicense
unlicense | name | unlicense | the unlicense
unlicense | url | unlicense | unlicense org
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | id | wtfpl | spdx license identifier wtfpl
wtfpl | name | wtfpl | (?:the )?wtfpl(?: (?:version |v )?2)?
wtfpl | name | fuck | do what the fuck you want to public licen[sc]e
wtfpl | url | wtfpl | wtfpl net
beerware | id | beerware | spdx license identifier beerware
beerware | name | beer | the beer ware licen[sc]e(?: revision 42)?
beerware | name | beerware | (?:the )?beerware licen[sc]e
cc0-1.0 | id | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | name | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | name | zero | creative commons zero(?: (?:v )?1 0)?(?: universal)?
cc0-1.0 | url | publicdomain | creativecommons org publicdomain zero 1 0
pddm | url | publicdomain | creativecommons org (?:publicdomain mark 1 0|licenses publicdomain)
cc-by-4.0 | id | cc | spdx license identifier cc by 4 0
cc-by-3.0 | id | cc | spdx license identifier cc by 3 0(?: us| de| at| nl| au| igo)?
cc-by-sa-4.0 | id | cc | spdx license identifier cc by sa 4 0
cc-by-sa-3.0 | id | cc | spdx license identifier cc by sa 3 0(?: de| at| igo)?
cc-by-nc-4.0 | id | cc | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | id | cc | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | id | cc | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | id | cc | spdx license identifier cc by nc nd 4 0
cc-by-4.0 | name | cc | cc by (?:v )?4 0
cc-by-3.0 | name | cc | cc by (?:v )?3 0
cc-by-2.5 | name | cc | cc by (?:v )?2 5
cc-by-2.0 | name | cc | cc by (?:v )?2 0
cc-by-sa-4.0 | name | cc | cc by sa (?:v )?4 0
cc-by-sa-3.0 | name | cc | cc by sa (?:v )?3 0
cc-by-sa-2.5 | name | cc | cc by sa (?:v )?2 5
cc-by-sa-2.0 | name | cc | cc by sa (?:v )?2 0
cc-by-nc-4.0 | name | cc | cc by nc (?:v )?4 0
cc-by-nc-3.0 | name | cc | cc by nc (?:v )?3 0
cc-by-nd-4.0 | name | cc | cc by nd (?:v )?4 0
cc-by-nd-3.0 | name | cc | cc by nd (?:v )?3 0
cc-by-nc-sa-4.0 | name | cc | cc by nc sa (?:v )?4 0
cc-by-nc-sa-3.0 | name | cc | cc by nc sa (?:v )?3 0
cc-by-nc-nd-4.0 | name | cc | cc by nc nd (?:v )?4 0
cc-by-nc-nd-3.0 | name | cc | cc by nc nd (?:v )?3 0
cc-by | name | cc | cc by
cc-by-sa | name | cc | cc by sa
cc-by-nc | name | cc | cc by nc
cc-by-nd | name | cc | cc by nd
cc-by-nc-sa | name | cc | cc by nc sa
cc-by-nc-nd | name | cc | cc by nc nd
cc-by-4.0 | name | attribution | creative commons attribution (?:4 0|4)(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-3.0 | name | attribution | creative commons attribution (?:3 0|3)(?: unported)?(?: licen[sc]e)?
cc-by | name | attribution | creative commons attribution(?: licen[sc]e)?
cc-by-sa-4.0 | name | sharealike | (?:creative commons )?attribution sharealike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-sa-3.0 | name | sharealike | (?:creative commons )?attribution sharealike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa | name | sharealike | creative commons attribution sharealike(?: licen[sc]e)?
cc-by-nc-4.0 | name | noncommercial | (?:creative commons )?attribution noncommercial 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc | name | noncommercial | creative commons attribution noncommercial(?: licen[sc]e)?
cc-by-nc-sa-4.0 | name | sharealike | (?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-sa | name | sharealike | creative commons attribution noncommercial sharealike(?: licen[sc]e)?
cc-by-nd-4.0 | name | noderivatives | (?:creative commons )?attribution noderivatives 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nd | name | noderivatives | creative commons attribution noderivatives(?: licen[sc]e)?
cc-by-nc-nd-4.0 | name | noderivatives | (?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-nd | name | noderivatives | creative commons attribution noncommercial noderivatives(?: licen[sc]e)?
cc-by-4.0 | url | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | url | creativecommons | creativecommons org licenses by 3 0
cc-by-2.0 | url | creativecommons | creativecommons org licenses by 2 [05]
cc-by-sa-4.0 | url | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | url | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | url | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | url | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | url | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | url | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | url | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | url | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | url | creativecommons | creativecommons org licenses by nc nd 3 0
cc | ref | commons | (?:a )?creative commons licen[sc]e
odbl-1.0 | id | odbl | spdx license identifier odbl 1 0
odbl-1.0 | name | database | (?:odc )?open database licen[sc]e(?: odbl)?(?: (?:v )?1 0)?
odbl-1.0 | url | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | id | odc | spdx license identifier odc by 1 0
odc-by-1.0 | name | commons | open data commons attribution licen[sc]e(?: (?:v )?1 0)?
odc-by-1.0 | url | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | id | pddl | spdx license identifier pddl 1 0
pddl-1.0 | name | commons | open data commons public domain dedication and licen[sc]e
ogl-uk-3.0 | id | ogl | spdx license identifier ogl uk [123] 0
ogl-uk-3.0 | name | government | (?:uk )?open government licen[sc]e(?: (?:version |v )?3 0)?
ecl-2.0 | id | ecl | spdx license identifier ecl 2 0
ecl-2.0 | name | educational | educational community licen[sc]e(?: (?:version |v )?[12] 0)?
eupl-1.1 | id | eupl | spdx license identifier eupl 1 1
eupl-1.1 | name | eupl | eupl (?:version |v )?1 1
eupl-1.2 | id | eupl | spdx license identifier eupl 1 2
eupl-1.2 | name | eupl | eupl (?:version |v )?1 2
eupl | name | european | european union public licen[sc]e(?: eupl)?(?: (?:version |v )?1 [0-2])?
cecill-2.1 | id | cecill | spdx license identifier cecill(?: b| c| 1 0| 1 1| 2 0| 2 1)
cecill | name | cecill | (?:the )?cecill(?: b| c)?(?: free software)? licen[sc]e(?: agreement)?(?: (?:version |v )?[12] [01])?
osl-3.0 | id | osl | spdx license identifier osl [123] [01]
osl-3.0 | name | software | open software licen[sc]e(?: osl)? (?:version |v )?3 0
afl-3.0 | id | afl | spdx license identifier afl [123] [012]
afl-3.0 | name | academic | academic free licen[sc]e(?: afl)?(?: (?:version |v )?[123] [012])?
qpl-1.0 | id | qpl | spdx license identifier qpl 1 0
qpl-1.0 | name | public | (?:the )?q public licen[sc]e(?: (?:version |v )?1 0)?
ms-pl | id | ms | spdx license identifier ms pl
ms-pl | name | microsoft | microsoft public licen[sc]e(?: ms pl)?
ms-rl | id | ms | spdx license identifier ms rl
ms-rl | name | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)?
ncsa | id | ncsa | spdx license identifier ncsa
ncsa | name | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
upl-1.0 | id | upl | spdx license identifier upl 1 0
upl-1.0 | name | permissive | universal permissive licen[sc]e(?: upl)?(?: (?:version |v )?1 0)?
vim | id | vim | spdx license identifier vim
vim | name | vim | (?:the )?vim licen[sc]e
tcl | id | tcl | spdx license identifier tcl
tcl | name | tcl | (?:the )?tcl(?: tk)? licen[sc]e
w3c | id | w3c | spdx license identifier w3c(?: 19980720| 20150513)?
w3c | name | w3c | (?:the )?w3c software (?:notice and |and document )?(?:notice and )?licen[sc]e
postgresql | id | postgresql | spdx license identifier postgresql
postgresql | name | postgresql | (?:the )?postgresql licen[sc]e
ofl-1.1 | id | ofl | spdx license identifier ofl 1 [01](?: rfn| no rfn)?
ofl-1.1 | name | font | (?:sil )?open font licen[sc]e(?: (?:version |v )?1 [01])?
ofl-1.1 | url | ofl | scripts sil org ofl
unicode | id | unicode | spdx license identifier unicode (?:dfs 2015|dfs 2016|3 0|tou)
unicode | name | unicode | unicode licen[sc]e(?: agreement)?(?: v3)?
icu | id | icu | spdx license identifier icu
icu | name | icu | (?:the )?icu licen[sc]e
ntp | id | ntp | spdx license identifier ntp
ntp | name | ntp | (?:the )?ntp licen[sc]e
sgi-b-2.0 | name | sgi | sgi free software licen[sc]e b(?: (?:version |v )?2 0)?
elastic-2.0 | id | elastic | spdx license identifier elastic 2 0
elastic-2.0 | name | elastic | (?:the )?elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?
sspl-1.0 | id | sspl | spdx license identifier sspl 1 0
sspl-1.0 | name | server | server side public licen[sc]e(?: sspl)?(?: (?:version |v )?1)?
busl-1.1 | id | busl | spdx license identifier busl 1 1
busl-1.1 | name | business | business source licen[sc]e(?: (?:version |v )?1 1)?
polyform | name | polyform | polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) licen[sc]e(?: 1 0 0)?
commons-clause | name | clause | (?:the )?commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?
blueoak-1.0.0 | id | blueoak | spdx license identifier blueoak 1 0 0
blueoak-1.0.0 | name | oak | blue oak model licen[sc]e(?: 1 0 0)?
mulan-psl-2.0 | id | mulanpsl | spdx license identifier mulanpsl [12] 0
mulan-psl-2.0 | name | mulan | mulan (?:psl|permissive software licen[sc]e)(?: v ?2)?
openrail | name | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?
openrail | name | rail | (?:bigscience |creativeml )?open rail m(?: licen[sc]e)?
llama | name | llama | llama (?:2|3|3 1|3 2|3 3) community licen[sc]e(?: agreement)?
public-domain | ref | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | ref | domain | (?:is|are) in the public domain
proprietary | ref | rights | all rights reserved
proprietary | ref | proprietary | proprietary and confidential
proprietary | ref | redistribute | do not (?:copy or )?redistribute
unknown | ref | license | see (?:the )?license (?:file|txt|md)(?: for (?:more )?(?:details|information))?
unknown | ref | licensed | (?:this (?:work|file|software|project|document|page) is )?licensed under (?:the )?(?:terms of )?(?:[^ ]+ ){1,5}licen[sc]e
"""


@dataclass(frozen=True)
class Rule:
    """One signature; ``pattern`` is over words joined by single spaces."""
    number: int
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """The pattern over words that carry one space on each side."""
        return " " + self.pattern.replace(" ", "  ") + " "


def rules() -> list[Rule]:
    """Base phrases first, then the signatures, numbered in this order."""
    out = [Rule(i, label, *KINDS["name"], words.split(" ")[0], words, True)
           for i, (words, label) in enumerate(BASE)]
    for line in _RULES.strip().splitlines():
        label, kind, keyword, pattern = (part.strip() for part in line.split(" | "))
        out.append(Rule(len(out), label, *KINDS[kind], keyword, pattern))
    return out
