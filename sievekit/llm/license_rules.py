"""The signatures of the license scan, written by hand: label, priority (0 first), weight, pattern over lower-case words.

Words are what stands between characters that are no letter or digit, so "GPL-2.0+" is "gpl 2 0". {v} is a version
number, {l} "or later" and the like, {u} the words that put a text under a license. A blank in a pattern is the
gap between two words; a pattern matches whole words.
"""

VERSION = "(?:version |v |v)?[0-9]+(?: [0-9]+)?"
LATER = "(?: (?:or|and) (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?| or later| only)?"
UNDER = "(?:licen[sc]ed|released|distributed|published|available|provided|covered|shared|redistributed|offered|dedicated|issued)(?: to you)?(?: under| by| with| to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: an?)?"

SIGNATURES = r"""
mit 0 0.99 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0 0.97 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit 0 0.95 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 0 0.90 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit 0 0.85 in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit 0 0.99 spdx licen[sc]e identifier mit
mit 0 0.98 spdx licen[sc]e identifier x11
mit 0 0.95 {u} mit licen[sc]e
mit 0 0.93 {u} (?:mit expat|expat|mit x11|x11) licen[sc]e
mit 0 0.90 {u} mit
mit 0 0.92 (?:subject to|governed by|in accordance with|see) the(?: terms of the)? mit licen[sc]e
mit 0 0.90 opensource org licen[sc]es? mit(?: licen[sc]e)?(?: php)?
mit 0 0.88 choosealicense com licen[sc]es mit
mit 1 0.85 mit x11 licen[sc]e
mit 1 0.85 (?:the )?expat licen[sc]e
mit 1 0.80 licen[sc]e mit
mit 2 0.70 (?:the )?mit licen[sc]e
mit-0 0 0.97 spdx licen[sc]e identifier mit 0
mit-0 1 0.85 mit no attribution(?: licen[sc]e)?
bsd 0 0.98 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 0 0.95 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 0 0.95 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd 0 0.95 neither the names? of .{1,120} nor the names of its contributors may be used to endorse or promote products
bsd 0 0.95 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 0 0.90 this software is provided by the (?:regents|copyright holders|authors?)(?: and contributors)? as is and any express or implied warranties
bsd 0 0.85 in no event shall the (?:regents|copyright (?:holder|owner)s?|authors?)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages
bsd 0 0.99 spdx licen[sc]e identifier bsd (?:1|2|3|4) clause(?: clear| patent| views| attribution| lbnl| uc)?
bsd 0 0.97 spdx licen[sc]e identifier bsd source code
bsd 0 0.95 {u} (?:new |modified |revised |simplified |original |old )?bsd(?: style| like| type)? licen[sc]e
bsd 0 0.95 {u} (?:2|3|4|two|three|four) clause bsd licen[sc]e
bsd 0 0.92 {u} bsd (?:2|3|4) clause(?: licen[sc]e)?
bsd 0 0.90 (?:subject to|governed by|see) the(?: terms of the)? bsd licen[sc]e
bsd 0 0.90 use of this source code is governed by a bsd style licen[sc]e
bsd 0 0.90 opensource org licen[sc]es? bsd (?:licen[sc]e|(?:2|3) clause)
bsd 1 0.88 bsd (?:2|3|4|two|three|four) clause(?: licen[sc]e)?
bsd 1 0.88 (?:2|3|4|two|three|four) clause bsd(?: licen[sc]e)?
bsd 1 0.85 (?:new|modified|revised|simplified|original|old) bsd licen[sc]e
bsd 1 0.80 bsd (?:2|3|4)
bsd 1 0.80 bsd(?: style| like) licen[sc]e
bsd 1 0.80 licen[sc]e bsd
bsd 2 0.70 (?:the )?bsd licen[sc]e
0bsd 0 0.98 spdx licen[sc]e identifier 0bsd
0bsd 1 0.85 bsd zero clause(?: licen[sc]e)?
0bsd 1 0.85 zero clause bsd(?: licen[sc]e)?
isc 0 0.97 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc 0 0.90 the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software
isc 0 0.90 loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
isc 0 0.99 spdx licen[sc]e identifier isc
isc 0 0.95 {u} isc licen[sc]e
isc 0 0.88 opensource org licen[sc]es? isc(?: licen[sc]e)?
isc 1 0.82 isc (?:licen[sc]e|style licen[sc]e)
isc 1 0.80 licen[sc]e isc
isc 2 0.60 isc 1(?: 0)?
zlib 0 0.97 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib 0 0.97 permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib 0 0.95 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 0 0.92 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 0 0.85 this notice may not be removed or altered from any source distribution
zlib 0 0.99 spdx licen[sc]e identifier zlib(?: acknowledgement)?
zlib 0 0.95 {u} zlib(?: libpng)? licen[sc]e
zlib 0 0.88 opensource org licen[sc]es? zlib(?: licen[sc]e)?
zlib 1 0.80 (?:the )?zlib(?: libpng)? licen[sc]e
libpng 0 0.97 spdx licen[sc]e identifier libpng(?: 2 0)?
libpng 1 0.80 (?:the )?libpng licen[sc]e
apache 0 0.98 licensed under the apache licen[sc]e {v}(?: the license)? you may not use this file except in compliance with the licen[sc]e
apache 0 0.95 you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at
apache 0 0.93 unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache 0 0.95 licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache 0 0.95 apache licen[sc]e version 2 0 january 2004
apache 0 0.93 grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you
apache 0 0.90 this product includes software developed by the apache (?:software foundation|group)
apache 0 0.99 spdx licen[sc]e identifier apache (?:1 0|1 1|2 0)
apache 0 0.95 {u} apache(?: software)? licen[sc]e(?: {v})?{l}
apache 0 0.92 {u} apache {v}(?: licen[sc]e)?
apache 0 0.90 {u} asl {v}(?: licen[sc]e)?
apache 0 0.92 (?:subject to|governed by|see|in compliance with) the(?: terms of the)? apache licen[sc]e(?: {v})?
apache 0 0.90 (?:www )?apache org licen[sc]es(?: licen[sc]e)?(?: [12] [01])?(?: txt| html)?
apache 0 0.88 opensource org licen[sc]es? apache ?(?: licen[sc]e)?(?: ?2 0)?
apache 1 0.87 apache(?: software)? licen[sc]e {v}
apache 1 0.85 apache (?:1 0|1 1|2 0)
apache 1 0.80 licen[sc]e apache
apache 2 0.70 (?:the )?apache(?: software)? licen[sc]e
gpl 0 0.98 this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation
gpl 0 0.97 either version [0-9] of the licen[sc]e or at your option any later version
gpl 0 0.93 this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl 0 0.95 you should have received a copy of the gnu general public licen[sc]e along with this (?:program|file|software|library|package)
gpl 0 0.95 gnu general public licen[sc]e version (?:1 february 1989|2 june 1991|3 29 june 2007)
gpl 0 0.93 the licenses for most software are designed to take away your freedom to share and change it
gpl 0 0.93 the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl 0 0.90 everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed
gpl 0 0.85 51 franklin (?:street|st) fifth floor boston ma
gpl 0 0.85 59 temple place suite 330 boston ma
gpl 0 0.99 spdx licen[sc]e identifier gpl (?:1 0|2 0|3 0)(?: only| or later)?(?: with [a-z]+(?: [a-z]+)? exception(?: [0-9] [0-9])?)?
gpl 0 0.95 {u} (?:gnu )?general public licen[sc]e(?: {v})?{l}
gpl 0 0.95 {u} gnu gpl(?: {v})?{l}
gpl 0 0.93 {u} gpl ?(?:{v})?{l}
gpl 0 0.92 {u} gplv[123]{l}
gpl 0 0.92 (?:subject to|governed by|see|in accordance with) the(?: terms of the)? (?:gnu )?general public licen[sc]e(?: {v})?
gpl 0 0.92 (?:subject to|governed by|see|in accordance with) the(?: terms of the)? (?:gnu )?gpl(?: {v})?
gpl 0 0.90 (?:www )?gnu org (?:licen[sc]es|copyleft)(?: old licen[sc]es)? gpl(?: [123] 0)?(?: html| txt)?
gpl 0 0.88 opensource org licen[sc]es? gpl(?: licen[sc]e| [123] 0)?
gpl 0 0.88 module licen[sc]e gpl(?: v2)?
gpl 1 0.87 gnu general public licen[sc]e {v}{l}
gpl 1 0.85 (?:gnu )?gpl {v}{l}
gpl 1 0.85 (?:gnu )?gplv[123]
gpl 1 0.85 gpl[123]
gpl 1 0.80 licen[sc]e gpl
gpl 1 0.80 gpl (?:compatible|licensed|licen[sc]e)
gpl 2 0.75 gnu general public licen[sc]e
gpl 2 0.65 (?:the )?general public licen[sc]e
gpl 2 0.65 (?:the )?gnu gpl
lgpl 0 0.98 this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl 0 0.95 you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this
lgpl 0 0.95 gnu (?:lesser|library) general public licen[sc]e version (?:2 june 1991|2 1 february 1999|3 29 june 2007)
lgpl 0 0.90 this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3
lgpl 0 0.99 spdx licen[sc]e identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?
lgpl 0 0.95 {u} (?:gnu )?(?:lesser|library) general public licen[sc]e(?: {v})?{l}
lgpl 0 0.94 {u} (?:gnu )?lgpl(?: {v})?{l}
lgpl 0 0.90 (?:www )?gnu org (?:licen[sc]es|copyleft)(?: old licen[sc]es)? (?:lgpl|lesser)(?: [23] [01])?(?: html| txt)?
lgpl 0 0.88 opensource org licen[sc]es? lgpl(?: licen[sc]e| [23] [01])?
lgpl 1 0.87 (?:gnu )?(?:lesser|library) general public licen[sc]e {v}{l}
lgpl 1 0.85 (?:gnu )?lgpl {v}{l}
lgpl 1 0.85 lgplv[23](?: 1)?
lgpl 1 0.80 licen[sc]e lgpl
lgpl 2 0.70 (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl 2 0.65 (?:gnu )?lgpl licen[sc]e
agpl 0 0.98 under the terms of the gnu affero general public licen[sc]e as published by the free software foundation
agpl 0 0.95 you should have received a copy of the gnu affero general public licen[sc]e along with this program
agpl 0 0.95 gnu affero general public licen[sc]e version 3 19 november 2007
agpl 0 0.99 spdx licen[sc]e identifier agpl (?:1 0|3 0)(?: only| or later)?
agpl 0 0.95 {u} (?:gnu )?affero general public licen[sc]e(?: {v})?{l}
agpl 0 0.94 {u} (?:gnu )?agpl(?: {v})?{l}
agpl 0 0.90 (?:www )?gnu org licen[sc]es agpl(?: 3 0)?(?: html| txt)?
agpl 1 0.87 (?:gnu )?affero general public licen[sc]e {v}{l}
agpl 1 0.85 (?:gnu )?agpl {v}{l}
agpl 1 0.85 agplv[13]
agpl 2 0.70 (?:gnu )?affero general public licen[sc]e
agpl 2 0.65 (?:gnu )?agpl licen[sc]e
gfdl 0 0.97 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl 0 0.93 with no invariant sections no front cover texts and no back cover texts
gfdl 0 0.99 spdx licen[sc]e identifier gfdl 1 [123](?: invariants| no invariants)?(?: only| or later)?
gfdl 0 0.94 {u} (?:gnu )?free documentation licen[sc]e(?: {v})?{l}
gfdl 0 0.94 {u} (?:gnu )?g?fdl(?: {v})?{l}
gfdl 0 0.90 (?:www )?gnu org (?:licen[sc]es|copyleft) fdl(?: 1 [123])?(?: html| txt)?
gfdl 1 0.85 (?:gnu )?gfdl {v}{l}
gfdl 1 0.80 (?:gnu )?free documentation licen[sc]e(?: {v})?{l}
mpl 0 0.97 this source code form is subject to the terms of the mozilla public licen[sc]e(?: v| version)? 2 0
mpl 0 0.95 if a copy of the mpl was not distributed with this file you can obtain one at
mpl 0 0.95 the contents of this file are subject to the mozilla public licen[sc]e(?: {v})?
mpl 0 0.93 this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e
mpl 0 0.99 spdx licen[sc]e identifier mpl (?:1 0|1 1|2 0)(?: no copyleft exception)?
mpl 0 0.95 {u} mozilla public licen[sc]e(?: {v})?{l}
mpl 0 0.93 {u} mpl(?: {v})?{l}
mpl 0 0.90 (?:www )?mozilla org (?:en us )?mpl(?: [12] [01])?(?: txt| html)?
mpl 0 0.88 opensource org licen[sc]es? mpl ?(?:[12] [01])?
mpl 1 0.87 mozilla public licen[sc]e {v}
mpl 1 0.85 mpl {v}
mpl 1 0.85 mplv[12](?: [01])?
mpl 2 0.70 mozilla public licen[sc]e
epl 0 0.96 this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl 0 0.94 all rights reserved this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) licen[sc]e
epl 0 0.99 spdx licen[sc]e identifier epl (?:1 0|2 0)
epl 0 0.95 {u} eclipse (?:public|distribution) licen[sc]e(?: {v})?{l}
epl 0 0.93 {u} epl {v}
epl 0 0.90 (?:www )?eclipse org (?:legal|org documents) (?:epl|edl)(?: ?v10| ?v20| [12] 0)?(?: html| php| txt)?
epl 1 0.87 eclipse (?:public|distribution) licen[sc]e {v}
epl 1 0.85 epl (?:v |v)?[12](?: 0)?
epl 2 0.70 eclipse (?:public|distribution) licen[sc]e
cddl 0 0.96 the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl 0 0.94 this file contains original code and or modifications of original code as defined in and that are subject to the cddl
cddl 0 0.99 spdx licen[sc]e identifier cddl 1 [01]
cddl 0 0.95 {u} common development and distribution licen[sc]e(?: cddl)?(?: {v})?
cddl 0 0.95 {u} cddl(?: {v})?
cddl 0 0.88 opensource org licen[sc]es? cddl ?1?(?: [01])?
cddl 1 0.85 common development and distribution licen[sc]e(?: {v})?
cddl 1 0.85 cddl {v}
cpl 0 0.95 {u} common public licen[sc]e(?: {v})?
cpl 0 0.98 spdx licen[sc]e identifier cpl 1 0
cpl 0 0.88 opensource org licen[sc]es? cpl ?1?(?: 0)?
cpl 1 0.82 common public licen[sc]e(?: {v})?
cpal 0 0.98 spdx licen[sc]e identifier cpal 1 0
cpal 1 0.85 common public attribution licen[sc]e(?: {v})?
ipl 0 0.98 spdx licen[sc]e identifier ipl 1 0
ipl 1 0.85 ibm public licen[sc]e(?: {v})?
apsl 0 0.98 spdx licen[sc]e identifier apsl [12] [012]
apsl 0 0.95 this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e
apsl 1 0.85 apple public source licen[sc]e(?: {v})?
artistic 0 0.96 the intent of this document is to state the conditions under which a package may be copied
artistic 0 0.93 you can redistribute it and or modify it under the same terms as perl itself
artistic 0 0.99 spdx licen[sc]e identifier artistic (?:1 0|2 0)(?: perl| cl8)?
artistic 0 0.94 {u} (?:perl |clarified )?artistic licen[sc]e(?: {v})?
artistic 0 0.88 (?:opensource org licen[sc]es?|perlfoundation org) artistic(?: licen[sc]e)?(?: [12] 0)?
artistic 1 0.85 artistic licen[sc]e {v}
artistic 2 0.65 (?:perl |clarified )?artistic licen[sc]e
boost 0 0.97 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
boost 0 0.95 distributed under the boost software licen[sc]e version 1 0
boost 0 0.93 see accompanying file licen[sc]e 1 0 txt or copy at
boost 0 0.99 spdx licen[sc]e identifier bsl 1 0
boost 0 0.90 (?:www )?boost org licen[sc]e 1 0 txt
boost 1 0.85 boost software licen[sc]e(?: {v})?
python 0 0.95 this licen[sc]e agreement is between the python software foundation psf and the individual or organization
python 0 0.90 psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e
python 0 0.98 spdx licen[sc]e identifier (?:python|psf) 2 0(?: 1)?
python 0 0.93 {u} (?:python(?: software foundation)?|psf) licen[sc]e(?: {v})?
python 0 0.88 docs python org (?:[23] )?licen[sc]e html
python 1 0.80 python software foundation licen[sc]e(?: {v})?
python 1 0.75 psf licen[sc]e(?: agreement)?
python 2 0.60 (?:the )?python licen[sc]e
ruby 0 0.98 spdx licen[sc]e identifier ruby
ruby 0 0.92 {u} same terms as ruby
ruby 0 0.92 {u} ruby(?: s)? licen[sc]e
ruby 2 0.60 (?:the )?ruby licen[sc]e
php 0 0.96 this source file is subject to version (?:2 02|3 0|3 01|3 0 1) of the php licen[sc]e
php 0 0.98 spdx licen[sc]e identifier php 3 (?:0|01)
php 0 0.88 (?:www )?php net licen[sc]e(?: [23] [0-9]+)?(?: txt)?
php 1 0.80 php licen[sc]e(?: {v})?
openssl 0 0.95 this product includes software developed by the openssl project for use in the openssl toolkit
openssl 0 0.98 spdx licen[sc]e identifier openssl
openssl 1 0.82 (?:dual )?openssl(?: ssleay)? licen[sc]e
openssl 0 0.93 this product includes cryptographic software written by eric young
unlicense 0 0.97 this is free and unencumbered software released into the public domain
unlicense 0 0.95 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 0 0.98 spdx licen[sc]e identifier unlicense
unlicense 0 0.93 {u} unlicense
unlicense 0 0.88 (?:www )?unlicense org
unlicense 2 0.65 the unlicense
wtfpl 0 0.97 do what the fuck you want to public licen[sc]e
wtfpl 0 0.95 everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed
wtfpl 0 0.98 spdx licen[sc]e identifier wtfpl
wtfpl 0 0.88 (?:www )?wtfpl net
wtfpl 1 0.85 wtfpl(?: {v})?(?: licen[sc]e)?
eupl 0 0.96 licensed under the eupl(?: version)?(?: {v})?
eupl 0 0.99 spdx licen[sc]e identifier eupl 1 [012]
eupl 0 0.94 {u} european union public licen[sc]e(?: {v})?
eupl 0 0.90 joinup ec europa eu (?:collection|software page|community) eupl
eupl 1 0.85 european union public licen[sc]e(?: {v})?
eupl 1 0.80 eupl {v}
ofl 0 0.97 this font software is licensed under the sil open font licen[sc]e
ofl 0 0.93 the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
ofl 0 0.99 spdx licen[sc]e identifier ofl 1 [01](?: rfn| no rfn)?
ofl 0 0.90 scripts sil org ofl
ofl 0 0.90 openfontlicense org
ofl 1 0.85 (?:sil )?open font licen[sc]e(?: {v})?
postgresql 0 0.96 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql 0 0.98 spdx licen[sc]e identifier postgresql
postgresql 1 0.82 (?:the )?postgresql licen[sc]e
ncsa 0 0.97 to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
ncsa 0 0.98 spdx licen[sc]e identifier ncsa
ncsa 1 0.85 university of illinois(?: ncsa)? open source licen[sc]e
ncsa 1 0.80 ncsa open source licen[sc]e
ms-pl 0 0.96 this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
ms-pl 0 0.98 spdx licen[sc]e identifier ms (?:pl|rl)
ms-pl 0 0.94 {u} microsoft (?:public|reciprocal) licen[sc]e
ms-pl 1 0.85 microsoft (?:public|reciprocal) licen[sc]e(?: ms (?:pl|rl))?
ms-pl 1 0.75 ms (?:pl|rl) licen[sc]e
sspl 0 0.97 under the terms of the server side public licen[sc]e(?: {v})?
sspl 0 0.98 spdx licen[sc]e identifier sspl 1 0
sspl 1 0.85 server side public licen[sc]e(?: {v})?
sspl 1 0.80 sspl (?:v |v)?1
busl 0 0.96 the business source licen[sc]e this document or the licen[sc]e is not an open source licen[sc]e
busl 0 0.98 spdx licen[sc]e identifier busl 1 1
busl 0 0.93 {u} business source licen[sc]e(?: {v})?
busl 1 0.85 business source licen[sc]e(?: {v})?
busl 1 0.80 bsl 1 1
elastic 0 0.97 you may not provide the software to third parties as a hosted or managed service
elastic 0 0.98 spdx licen[sc]e identifier elastic 2 0
elastic 1 0.85 elastic licen[sc]e(?: {v})?
commons-clause 0 0.97 the software is provided to you by the licensor under the licen[sc]e as defined below subject to the following condition
commons-clause 1 0.82 commons clause(?: licen[sc]e| condition)
polyform 0 0.98 spdx licen[sc]e identifier polyform (?:noncommercial|small business) 1 0 0
polyform 1 0.85 polyform (?:noncommercial|small business|shield|perimeter|strict|internal use) licen[sc]e(?: {v})?
prosperity 1 0.85 prosperity public licen[sc]e(?: {v})?
parity 1 0.85 parity public licen[sc]e(?: {v})?
osl 0 0.98 spdx licen[sc]e identifier osl [123] [01]
osl 0 0.93 licensed under the open software licen[sc]e(?: {v})?
osl 1 0.82 open software licen[sc]e(?: {v})?
afl 0 0.98 spdx licen[sc]e identifier afl [123] [012]
afl 0 0.93 licensed under the academic free licen[sc]e(?: {v})?
afl 1 0.82 academic free licen[sc]e(?: {v})?
ecl 0 0.98 spdx licen[sc]e identifier ecl [12] 0
ecl 1 0.82 educational community licen[sc]e(?: {v})?
qpl 0 0.98 spdx licen[sc]e identifier qpl 1 0
qpl 1 0.80 (?:q|qt) public licen[sc]e(?: {v})?
sleepycat 0 0.98 spdx licen[sc]e identifier sleepycat
sleepycat 1 0.82 sleepycat licen[sc]e
upl 0 0.98 spdx licen[sc]e identifier upl 1 0
upl 1 0.85 universal permissive licen[sc]e(?: {v})?
mulan 0 0.98 spdx licen[sc]e identifier mulanpsl [12] 0
mulan 0 0.93 licensed under mulan psl v[12]
mulan 1 0.85 mulan permissive software licen[sc]e(?: {v})?
cecill 0 0.98 spdx licen[sc]e identifier cecill(?: b| c| 1 [01]| 2 [01])?
cecill 0 0.93 this software is governed by the cecill(?: b| c)? licen[sc]e under french law
cecill 1 0.80 cecill(?: b| c)? licen[sc]e
vim 0 0.97 spdx licen[sc]e identifier vim
vim 1 0.75 vim licen[sc]e
curl 0 0.97 spdx licen[sc]e identifier curl
curl 1 0.75 curl licen[sc]e
json 0 0.97 the software shall be used for good not evil
json 0 0.97 spdx licen[sc]e identifier json
beerware 0 0.96 as long as you retain this notice you can do whatever you want with this stuff
beerware 0 0.96 if we meet some day and you think this stuff is worth it you can buy me a beer
beerware 1 0.82 beer ?ware licen[sc]e
hpnd 0 0.97 spdx licen[sc]e identifier hpnd(?: sell variant)?
hpnd 0 0.88 permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose is hereby granted without fee
w3c 0 0.97 spdx licen[sc]e identifier w3c(?: 19980720| 20150513)?
w3c 1 0.82 w3c software(?: notice and| and document)? licen[sc]e
latex 0 0.95 this work may be distributed and or modified under the conditions of the latex project public licen[sc]e
latex 0 0.98 spdx licen[sc]e identifier lppl 1 [0123](?: a| c)?
latex 1 0.82 latex project public licen[sc]e(?: {v})?
odbl 0 0.94 {u} open (?:database|data commons open database) licen[sc]e(?: odbl)?(?: {v})?
odbl 0 0.98 spdx licen[sc]e identifier odbl 1 0
odbl 0 0.90 opendatacommons org licen[sc]es odbl(?: 1 0)?
odbl 1 0.85 open(?: data commons open)? database licen[sc]e(?: {v})?
odbl 1 0.80 odbl (?:v |v)?1(?: 0)?
odc-by 0 0.98 spdx licen[sc]e identifier odc by 1 0
odc-by 0 0.90 opendatacommons org licen[sc]es by(?: 1 0)?
odc-by 1 0.85 open data commons attribution licen[sc]e(?: {v})?
odc-by 1 0.80 odc by(?: {v})?
pddl 0 0.98 spdx licen[sc]e identifier pddl 1 0
pddl 0 0.90 opendatacommons org licen[sc]es pddl(?: 1 0)?
pddl 1 0.85 public domain dedication and licen[sc]e(?: pddl)?(?: {v})?
cdla 0 0.98 spdx licen[sc]e identifier cdla (?:permissive|sharing) [12] 0
cdla 0 0.90 cdla (?:io|dev)(?: (?:permissive|sharing) [12] 0)?
cdla 1 0.85 community data licen[sc]e agreement(?: permissive| sharing)?(?: {v})?
rail 0 0.93 {u} (?:creativeml |bigscience |bigcode )?open ?rail(?: m| s| d| a)?(?: licen[sc]e)?
rail 0 0.90 you agree not to use the model or derivatives of the model in any way that violates any applicable
rail 1 0.85 (?:creativeml |bigscience |bigcode )?open ?rail(?: m| s| d| a)?(?: {v}| licen[sc]e)
rail 1 0.80 responsible ai licen[sc]e
llama 0 0.95 (?:meta )?llama (?:[234] |3 [123] )?is licensed under the llama (?:[234] |3 [123] )?community licen[sc]e
llama 1 0.85 llama (?:[234] |3 [123] )?community licen[sc]e(?: agreement)?
gemma 1 0.80 gemma (?:terms of use|licen[sc]e)
cc0 0 0.96 has waived all copyright and related or neighboring rights to
cc0 0 0.96 to the extent possible under law .{1,120} has waived all copyright
cc0 0 0.98 spdx licen[sc]e identifier cc0 1 0
cc0 0 0.94 {u} (?:creative commons )?cc0(?: {v})?(?: universal)?(?: licen[sc]e)?
cc0 0 0.94 {u} (?:creative commons )?cc zero(?: {v})?(?: universal)?(?: licen[sc]e)?
cc0 0 0.92 creativecommons org publicdomain zero(?: 1 0)?(?: legalcode)?
cc0 1 0.87 creative commons (?:zero|cc0)(?: {v})?(?: universal)?
cc0 1 0.85 cc0(?: {v})?(?: universal| licen[sc]e)?
public-domain 0 0.92 creativecommons org (?:publicdomain mark|licen[sc]es publicdomain)(?: 1 0)?
public-domain 0 0.90 (?:released|placed|dedicated|put|donated)(?: into| in| to) the public domain
public-domain 1 0.80 (?:is|are) (?:in|part of) the public domain
public-domain 1 0.75 public domain (?:dedication|mark|notice)
cc-by 0 0.95 this work is licensed under a creative commons attribution(?: {v})?(?: international| generic| unported)? licen[sc]e
cc-by 0 0.98 spdx licen[sc]e identifier cc by [1234] [05]
cc-by 0 0.94 {u} creative commons attribution(?: licen[sc]e)?(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by 0 0.94 {u} cc by(?: {v})?(?: licen[sc]e)?
cc-by 0 0.92 creativecommons org licen[sc]es by(?: [1234] [05])?(?: legalcode| deed)?
cc-by 1 0.87 creative commons attribution {v}(?: international| generic| unported)?(?: licen[sc]e)?
cc-by 1 0.85 cc by {v}
cc-by 2 0.70 creative commons attribution(?: international| generic| unported)?(?: licen[sc]e)?
cc-by 2 0.65 cc by
cc-by-sa 0 0.95 this work is licensed under a creative commons attribution share ?alike(?: {v})?(?: international| generic| unported)? licen[sc]e
cc-by-sa 0 0.98 spdx licen[sc]e identifier cc by sa [1234] [05]
cc-by-sa 0 0.94 {u} creative commons attribution share ?alike(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-sa 0 0.94 {u} cc by sa(?: {v})?(?: licen[sc]e)?
cc-by-sa 0 0.92 creativecommons org licen[sc]es by sa(?: [1234] [05])?(?: legalcode| deed)?
cc-by-sa 0 0.90 text is available under the creative commons attribution share ?alike licen[sc]e
cc-by-sa 1 0.87 creative commons attribution share ?alike(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-sa 1 0.85 cc by sa(?: {v})?
cc-by-nd 0 0.98 spdx licen[sc]e identifier cc by nd [1234] [05]
cc-by-nd 0 0.94 {u} creative commons attribution no ?deriv(?:ative|ative work)?s(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nd 0 0.94 {u} cc by nd(?: {v})?(?: licen[sc]e)?
cc-by-nd 0 0.92 creativecommons org licen[sc]es by nd(?: [1234] [05])?(?: legalcode| deed)?
cc-by-nd 1 0.87 creative commons attribution no ?deriv(?:ative|ative work)?s(?: {v})?(?: licen[sc]e)?
cc-by-nd 1 0.85 cc by nd(?: {v})?
cc-by-nc 0 0.98 spdx licen[sc]e identifier cc by nc [1234] [05]
cc-by-nc 0 0.94 {u} creative commons attribution non ?commercial(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nc 0 0.94 {u} cc by nc(?: {v})?(?: licen[sc]e)?
cc-by-nc 0 0.92 creativecommons org licen[sc]es by nc(?: [1234] [05])?(?: legalcode| deed)?
cc-by-nc 1 0.87 creative commons attribution non ?commercial(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nc 1 0.85 cc by nc(?: {v})?
cc-by-nc-sa 0 0.98 spdx licen[sc]e identifier cc by nc sa [1234] [05]
cc-by-nc-sa 0 0.94 {u} creative commons attribution non ?commercial share ?alike(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nc-sa 0 0.94 {u} cc by nc sa(?: {v})?(?: licen[sc]e)?
cc-by-nc-sa 0 0.92 creativecommons org licen[sc]es by nc sa(?: [1234] [05])?(?: legalcode| deed)?
cc-by-nc-sa 1 0.87 creative commons attribution non ?commercial share ?alike(?: {v})?(?: licen[sc]e)?
cc-by-nc-sa 1 0.85 cc by nc sa(?: {v})?
cc-by-nc-nd 0 0.98 spdx licen[sc]e identifier cc by nc nd [1234] [05]
cc-by-nc-nd 0 0.94 {u} creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s(?: {v})?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nc-nd 0 0.94 {u} cc by nc nd(?: {v})?(?: licen[sc]e)?
cc-by-nc-nd 0 0.92 creativecommons org licen[sc]es by nc nd(?: [1234] [05])?(?: legalcode| deed)?
cc-by-nc-nd 1 0.87 creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s(?: {v})?(?: licen[sc]e)?
cc-by-nc-nd 1 0.85 cc by nc nd(?: {v})?
open-government 0 0.95 contains public sector information licensed under the open government licen[sc]e(?: {v})?
open-government 0 0.98 spdx licen[sc]e identifier ogl (?:uk )?[123] 0
open-government 1 0.85 open government licen[sc]e(?: {v})?
proprietary 0 0.92 this software is the confidential and proprietary information of
proprietary 0 0.90 unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary 0 0.88 proprietary and confidential
proprietary 1 0.75 (?:this|the) (?:software|program|material|document) is proprietary
proprietary 2 0.60 all rights reserved
copyright 2 0.50 copyright c (?:19|20)[0-9][0-9]
"""
