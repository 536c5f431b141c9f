"""License scans by ordered signature rules, in DataFrame functions only.

A text is reduced to its words with single spaces. Rules whose keyword occurs are matched; every match is an interval of
words. Intervals that lie inside one of the same or a stronger tier are suppressed; the weakest tier, which names no
license, speaks only where nothing else is left. A statement that something is not under a license suppresses the name in
it and gives no label. All of it stays within a row: no shuffle.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import read

#: Labels, and the ways in which each license is named (as words; the first is also its short name).
FAMILIES = {
    "mit": ("mit", "expat", "mit x11"),
    "apache": ("apache", "apache software", "asl"),
    "gpl": ("gpl", "gnu general public", "general public", "gnu gpl"),
    "lgpl": ("lgpl", "gnu lesser general public", "gnu library general public", "lesser general public", "gnu lgpl"),
    "agpl": ("agpl", "gnu affero general public", "affero general public", "gnu agpl"),
    "gfdl": ("gfdl", "gnu free documentation", "free documentation"),
    "bsd": ("bsd", "2 clause bsd", "3 clause bsd", "4 clause bsd", "new bsd", "simplified bsd", "modified bsd", "berkeley software distribution"),
    "0bsd": ("0bsd", "zero clause bsd", "bsd zero clause"),
    "mpl": ("mpl", "mozilla public"),
    "epl": ("epl", "eclipse public"),
    "eupl": ("eupl", "european union public"),
    "cddl": ("cddl", "common development and distribution"),
    "cpl": ("cpl", "common public"),
    "ipl": ("ipl", "ibm public"),
    "cc-by": ("cc by", "creative commons attribution", "creative commons by"),
    "cc-by-sa": ("cc by sa", "creative commons attribution share alike", "creative commons attribution sharealike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution non commercial", "creative commons attribution noncommercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution no derivatives", "creative commons attribution noderivatives"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"),
    "cc0": ("cc0", "creative commons zero", "cc zero"),
    "isc": ("isc", "internet systems consortium"),
    "zlib": ("zlib", "zlib libpng", "libpng"),
    "boost": ("bsl 1 0", "boost software", "boost"),
    "unlicense": ("unlicense", "the unlicense"),
    "wtfpl": ("wtfpl", "do what the fuck you want to public"),
    "artistic": ("artistic", "perl artistic", "clarified artistic"),
    "psf": ("psf", "python software foundation", "python"),
    "postgresql": ("postgresql",),
    "openssl": ("openssl", "ssleay"),
    "ofl": ("ofl", "sil open font", "open font"),
    "odbl": ("odbl", "open database", "open data commons open database"),
    "odc-by": ("odc by", "open data commons attribution"),
    "pddl": ("pddl", "open data commons public domain dedication and"),
    "busl": ("busl", "business source"),
    "sspl": ("sspl", "server side public"),
    "elastic": ("elastic", "elastic 2 0"),
    "ms-pl": ("ms pl", "microsoft public"),
    "ms-rl": ("ms rl", "microsoft reciprocal"),
    "ncsa": ("ncsa", "university of illinois ncsa open source"),
    "afl": ("afl", "academic free"),
    "osl": ("osl", "open software"),
    "qpl": ("qpl", "q public"),
    "sleepycat": ("sleepycat",),
    "php": ("php",),
    "ruby": ("ruby",),
    "vim": ("vim",),
    "w3c": ("w3c", "w3c software notice and"),
    "curl": ("curl",),
    "json": ("json",),
    "beerware": ("beerware", "beer ware"),
    "mulan": ("mulan", "mulan permissive software"),
    "unicode": ("unicode", "unicode data files and software"),
    "upl": ("upl", "universal permissive"),
    "etalab": ("etalab", "etalab open"),
    "ogl-uk": ("ogl", "open government"),
    "llama": ("llama", "llama community", "llama 2 community", "llama 3 community"),
    "openrail": ("openrail", "open rail", "bigscience rail", "creativeml open rail m"),
}
#: Rules written by hand for notices and sentences of single licenses: keyword, label, words (a pattern over single-spaced words).
NOTICES = """
granted free of charge | mit | permission is hereby granted free of charge to any person obtaining a copy
without limitation the rights | mit | without limitation the rights to use copy modify merge publish distribute sublicense and or sell
substantial portions | mit | (?:copyright notice|permission notice) shall be included in all copies or substantial portions
opensource org | mit | (?:www )?opensource org licenses? mit(?: license)?(?: php)?
mit | mit | mit style licen[cs]e
with or without fee | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
with or without fee | isc | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
opensource org | isc | (?:www )?opensource org licenses? isc
redistribution and use | bsd | redistribution and use in source and binary forms with or without modification are permitted
redistributions | bsd | redistributions of source code must retain the above copyright notice
redistributions | bsd | redistributions in binary form must reproduce the above copyright notice
endorse or promote | bsd | neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8}? nor the names of (?:its|the|any) contributors may be used to endorse or promote products
advertising materials | bsd | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
regents | bsd | the regents of the university of california
opensource org | bsd | (?:www )?opensource org licenses? bsd(?: [0-9] clause| license)?(?: php)?
bsd | bsd | bsd style licen[cs]e
bsd | bsd | (?:two|three|four|2|3|4) clause bsd(?: licen[cs]e)?
bsd | bsd | bsd (?:2|3|4) clause(?: (?:new|simplified|original|revised|clear))?(?: or [^ ]+)?(?: licen[cs]e)?
any purpose with or without fee | 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
compliance with the license | apache | you may not use this (?:file|work|software|product|project|library|package) except in compliance with the license
obtain a copy of the license | apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses
apache org | apache | (?:https? )?(?:www )?apache org licenses license [0-9](?: [0-9])?(?: (?:txt|html))?
distributed on an | apache | distributed on an as is basis without warranties or conditions of any kind
contributor license | apache | contributor license agreements? see the notice file
apache | apache | licensed to the apache software foundation asf
apache | apache | (?:the )?apache 2(?: 0)? licen[cs]e
apache | apache | apache software foundation licen[cs]e
llvm exception | apache-llvm-exception | apache(?: license)?(?: version)? 2 0 with llvm exceptions?
published by the free software foundation | gpl | under the terms of the gnu general public license(?: version [0-9](?: [0-9])?)? as published by the free software foundation
either version | gpl | gnu general public license as published by the free software foundation either version [0-9](?: [0-9])? of the license or at your option any later version
version 2 | gpl | gnu general public license(?: as published by the free software foundation)? (?:only )?version 2(?: only| as published)?
version 3 | gpl | gnu general public license(?: as published by the free software foundation)? version 3(?: only| or later)?
copy of the gnu general public | gpl | you should have received a copy of the gnu general public license along with
gnu org | gpl | (?:www )?gnu org licenses? (?:old licenses )?gpl(?: [0-9](?: [0-9])?)?(?: (?:html|txt))?
gpl | gpl | (?:gnu )?gplv?[ ]?[123](?: [0-9])?(?: or (?:any )?later| only| plus)?
gpl | gpl | licen[cs]ed under (?:the )?(?:gnu )?gpl(?:v?[123])?
permission to link | gpl-linking-exception | as a special exception (?:[^ ]+ ){0,12}?permission to link
classpath | gpl-classpath-exception | gpl(?: [0-9]( [0-9])?)?(?: only| or later)? with classpath exception(?: [0-9] [0-9])?
classpath exception | gpl-classpath-exception | classpath exception as provided by
gcc runtime | gpl-gcc-exception | gcc runtime library exception
bison exception | gpl-bison-exception | (?:with )?bison exception(?: 2 2)?
autoconf | gpl-autoconf-exception | (?:with )?autoconf (?:configure script )?exception
font exception | gpl-font-exception | gpl(?: [0-9]( [0-9])?)? with font exception
published by the free software foundation | lgpl | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
you should have received | lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
gnu org | lgpl | (?:www )?gnu org licenses? (?:old licenses )?lgpl(?: [0-9](?: [0-9])?)?(?: (?:html|txt))?
lgpl | lgpl | (?:gnu )?lgplv?[ ]?[23](?: [0-9])?(?: or (?:any )?later| only| plus)?
published by the free software foundation | agpl | under the terms of the gnu affero general public license as published by the free software foundation
copy of the gnu affero | agpl | you should have received a copy of the gnu affero general public license along with
gnu org | agpl | (?:www )?gnu org licenses? agpl(?: 3(?: 0)?)?(?: html)?
agpl | agpl | (?:gnu )?agplv?[ ]?[13](?: 0)?(?: or (?:any )?later| only| plus)?
remote network interaction | agpl | remote network interaction use with the gnu general public license
free documentation | gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
invariant sections | gfdl | with no invariant sections no front cover texts and no back cover texts
gnu org | gfdl | (?:www )?gnu org licenses? (?:old licenses )?fdl(?: 1 [0-9])?(?: html)?
source code form is subject | mpl | this source code form is subject to the terms of the mozilla public license
mozilla org | mpl | (?:www )?mozilla org (?:en us )?mpl(?: [0-9] [0-9])?
incompatible with secondary | mpl-no-copyleft-exception | this source code form is incompatible with secondary licenses
contents of this file are subject | mpl | the contents of this file are subject to the mozilla public license
contents of this file are subject | npl | the contents of this file are subject to the netscape public license
contents of this file are subject | cddl | the contents of this file are subject to the terms of the common development and distribution license
accompanying materials | epl | this program and the accompanying materials are made available under the terms of the eclipse public license
eclipse org | epl | (?:www )?eclipse org legal epl(?: v?[12]0| [12] 0| 2 0| v[12] 0)?(?: html)?
accompanying materials | cpl | this program and the accompanying materials are made available under the terms of the common public license
under the eupl | eupl | licensed under the eupl(?: version)?(?: 1 [0-9])?(?: or as soon they will be approved by the european commission)?
altered source versions | zlib | altered source versions must be plainly marked as such
origin of this software | zlib | the origin of this software must not be misrepresented
boost software | boost | distributed under the boost software license version 1 0
boost org | boost | (?:www )?boost org license 1 0 txt
machine executable object | boost | machine executable object code generated by a source language processor
unencumbered software | unlicense | this is free and unencumbered software released into the public domain
unlicense org | unlicense | (?:https? )?(?:www )?unlicense org
what the fuck you want | wtfpl | you just do what the fuck you want to
wtfpl net | wtfpl | (?:www )?wtfpl net
artistic | artistic | (?:the )?artistic licen[cs]e(?: version)? [12](?: 0)?
same terms as perl | perl | under the same terms as perl(?: itself| 5)?
same terms as ruby | ruby | under the same terms as ruby(?: itself)?
as python | psf | under the same licen[cs]e as python(?: itself)?
python software foundation | psf | python software foundation license(?: version 2)?
beer in return | beerware | you can buy me a beer in return
this stuff is worth it | beerware | if we meet some day and you think this stuff is worth it
used for good not evil | json | the software shall be used for good not evil
openssl toolkit | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
eric young | openssl | this product includes cryptographic software written by eric young
reserved font name | ofl | with reserved font name
sil open font | ofl | this font software is licensed under the sil open font license(?: version 1 1)?
scripts sil org | ofl | scripts sil org(?: ofl)?
openfontlicense org | ofl | openfontlicense org(?: ofl)?
for any purpose without fee | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee
w3 org | w3c | (?:www )?w3 org consortium legal (?:[0-9]+ )?copyright software
unicode | unicode | (?:www )?unicode org (?:copyright|license)(?: html| txt)?
waived all copyright | cc0 | waived all copyright and related or neighboring rights
publicdomain zero | cc0 | (?:https? )?creativecommons org publicdomain zero(?: 1 0)?
publicdomain mark | public-domain | (?:https? )?creativecommons org publicdomain mark(?: 1 0)?
creativecommons org | cc-by | (?:https? )?creativecommons org licenses by(?: [1-4] [05])?
creativecommons org | cc-by-sa | (?:https? )?creativecommons org licenses by sa(?: [1-4] [05])?
creativecommons org | cc-by-nc | (?:https? )?creativecommons org licenses by nc(?: [1-4] [05])?
creativecommons org | cc-by-nd | (?:https? )?creativecommons org licenses by nd(?: [1-4] [05])?
creativecommons org | cc-by-nc-sa | (?:https? )?creativecommons org licenses by nc sa(?: [1-4] [05])?
creativecommons org | cc-by-nc-nd | (?:https? )?creativecommons org licenses by nc nd(?: [1-4] [05])?
cc by | cc-by | cc by (?:[1-4] [05]|international|unported)
cc by sa | cc-by-sa | cc by sa (?:[1-4] [05]|international|unported)
cc by nc | cc-by-nc | cc by nc (?:[1-4] [05]|international|unported)
cc by nc sa | cc-by-nc-sa | cc by nc sa (?:[1-4] [05]|international|unported)
creative commons attribution share | cc-by-sa | creative commons attribution share ?alike [1-4] [05](?: (?:international|unported|generic))?(?: public)?(?: license)?
creative commons | cc-by | this work is licensed under a creative commons attribution [1-4] [05](?: (?:international|unported|generic))?(?: public)? license
creative commons | creative-commons | (?:a|the|under|some) creative commons licen[cs]e
some rights reserved | creative-commons | some rights reserved
opendatacommons org | odbl | (?:www )?opendatacommons org licenses? odbl(?: [^ ]+)?
opendatacommons org | odc-by | (?:www )?opendatacommons org licenses? by(?: [^ ]+)?
opendatacommons org | pddl | (?:www )?opendatacommons org licenses? pddl(?: [^ ]+)?
open government | ogl-uk | contains public sector information licensed under the open government licence(?: v[123](?: 0)?)?
licence ouverte | etalab | licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?
business source license | busl | change (?:date|license) (?:[^ ]+ ){0,8}?business source license
additional use grant | busl | additional use grant
commons clause | commons-clause | (?:the )?commons clause(?: license condition)?(?: v?1 0)?
server side public license | sspl | server side public license(?: version 1| v1)?
elastic | elastic | elastic license(?: version)?(?: 2 0| v2)
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use)(?: license)?(?: 1 0 0)?
open rail | openrail | (?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[cs]e)?
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
llama | llama | llama [23](?: [123])? community license(?: agreement)?
gemma | gemma | gemma (?:terms of use|license)
public domain | public-domain | (?:released|placed|dedicated|put|given|donated) (?:in|into|to) the public domain
public domain | public-domain | (?:is|are|was|were) (?:hereby )?(?:in|part of) the public domain
public domain | public-domain | public domain (?:dedication|software|work|notice)
copyright | public-domain | no (?:known )?copyright (?:restrictions|is claimed)
government | public-domain | work of the (?:us|u s|united states) government
all rights reserved | proprietary | all rights reserved
confidential | proprietary | (?:proprietary and confidential|confidential and proprietary)
unauthorized copying | proprietary | unauthorized copying of this file(?: via any medium)? is strictly prohibited
may not be reproduced | proprietary | may not be reproduced (?:distributed )?(?:in whole or in part )?without (?:the )?(?:prior |express |written )*permission
commercial licen | commercial | (?:a )?commercial licen[cs]e (?:is|must be|can be|may be) (?:required|obtained|purchased|available)
end user | eula | end user licen[cs]e agreement
use only | non-commercial | (?:for )?(?:personal|educational|academic|research)(?: and| or)? (?:[^ ]+ )?(?:non ?commercial )?use only
commercial | non-commercial | for non ?commercial (?:use|purposes)(?: only)?
freeware | freeware | (?:is|as|this) freeware
shareware | shareware | (?:is|as|this) shareware
dual licen | dual-licensed | (?:is |are )?dual licen[cs]ed
the software is provided as is | mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
authors or copyright holders be liable | mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit no attribution | mit-0 | mit no attribution(?: licen[cs]e)?
opensource org | mit-0 | (?:www )?opensource org licenses? mit 0
spdx org | mit | (?:www )?spdx org licenses? mit(?: html)?
choosealicense com | mit | (?:www )?choosealicense com licenses? mit
choosealicense com | apache | (?:www )?choosealicense com licenses? apache 2 0
choosealicense com | gpl | (?:www )?choosealicense com licenses? gpl [23] 0
choosealicense com | mpl | (?:www )?choosealicense com licenses? mpl 2 0
choosealicense com | unlicense | (?:www )?choosealicense com licenses? unlicense
spdx org | apache | (?:www )?spdx org licenses? apache [12] [01](?: html)?
spdx org | bsd | (?:www )?spdx org licenses? bsd [234] clause(?: html)?
spdx org | gpl | (?:www )?spdx org licenses? gpl [123] 0(?: only| or later)?(?: html)?
spdx org | lgpl | (?:www )?spdx org licenses? lgpl [23] [01](?: only| or later)?(?: html)?
spdx org | mpl | (?:www )?spdx org licenses? mpl [12] [01](?: html)?
opensource org | apache | (?:www )?opensource org licenses? apache(?: license)?(?: 2 0)?(?: php)?
opensource org | gpl | (?:www )?opensource org licenses? gpl(?: license)?(?: [23] 0)?(?: php)?
opensource org | lgpl | (?:www )?opensource org licenses? lgpl(?: license)?(?: [23] [01])?(?: php)?
opensource org | mpl | (?:www )?opensource org licenses? mpl(?: 2 0| 1 1)?(?: php)?
opensource org | epl | (?:www )?opensource org licenses? epl(?: 1 0| 2 0)?(?: php)?
opensource org | zlib | (?:www )?opensource org licenses? zlib(?: license)?(?: php)?
opensource org | artistic | (?:www )?opensource org licenses? artistic(?: license)?(?: 2 0)?(?: php)?
opensource org | ncsa | (?:www )?opensource org licenses? ncsa
opensource org | cddl | (?:www )?opensource org licenses? cddl(?: 1 0)?
opensource org | osl | (?:www )?opensource org licenses? osl(?: 3 0)?
opensource org | afl | (?:www )?opensource org licenses? afl(?: 3 0)?
opensource org | upl | (?:www )?opensource org licenses? upl
opensource org | boost | (?:www )?opensource org licenses? bsl 1 0
opensource org | postgresql | (?:www )?opensource org licenses? postgresql
opensource org | eupl | (?:www )?opensource org licenses? eupl(?: 1 [12])?
opensource org | 0bsd | (?:www )?opensource org licenses? 0bsd
opensource org | agpl | (?:www )?opensource org licenses? agpl(?: 3 0)?
opensource org | ms-pl | (?:www )?opensource org licenses? ms pl
microsoft public | ms-pl | (?:under the )?microsoft public licen[cs]e(?: ms pl)?
microsoft reciprocal | ms-rl | (?:under the )?microsoft reciprocal licen[cs]e(?: ms rl)?
isc license | isc | (?:the )?isc license(?: isc)?
internet systems consortium | isc | internet systems consortium inc isc
use of this source code is governed | bsd | use of this source code is governed by a bsd style license(?: that can be found in the license file)?
use of this source code is governed | mit | use of this source code is governed by an mit style license(?: that can be found in the license file)?
use of this source code is governed | apache | use of this source code is governed by (?:the|an) apache(?: license)?(?: version)? 2 0(?: license)?
grant of patent license | apache | grant of patent license subject to the terms and conditions of this license
grant of copyright license | apache | grant of copyright license subject to the terms and conditions of this license
terms and conditions for use reproduction | apache | terms and conditions for use reproduction and distribution
limitations under the license | apache | see the license for the specific language governing permissions and limitations under the license
apache license version 1 1 | apache | (?:the )?apache license version 1 1
everyone is permitted to copy | gpl | everyone is permitted to copy and distribute verbatim copies of this license document
without even the implied warranty | gpl | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
free software you can redistribute | gpl | (?:this program|this file|it) is free software you can redistribute it and or modify it
library is free software | lgpl | this library is free software you can redistribute it and or modify it
gnu library general | lgpl | gnu library general public license(?: as published by the free software foundation)?
gnu lesser general public license version | lgpl | gnu lesser general public license version (?:2 1|3)(?: only| or later)?
gnu affero general public license version | agpl | gnu affero general public license version 3(?: only| or later)?
nonfree | proprietary | nonfree(?: software)? licen[cs]e
qt commercial | qt-commercial | (?:under the )?qt commercial license(?: agreement)?
universal foss exception | gpl-foss-exception | (?:the )?universal foss exception(?: version 1 0)?
foss license exception | gpl-foss-exception | (?:mysql )?foss license exception
linux syscall note | linux-syscall-note | (?:with )?linux syscall note
u boot exception | gpl-uboot-exception | (?:with )?u boot exception(?: 2 0)?
openssl exception | gpl-openssl-exception | (?:with )?(?:the )?openssl exception
openjdk assembly exception | gpl-classpath-exception | openjdk assembly exception(?: 1 0)?
swift exception | apache-swift-exception | (?:with )?swift exception
runtime library exception | apache-swift-exception | apache license v2 0 with runtime library exception
mozilla public license v 2 0 | mpl | mozilla public license v 2 0
exhibit b incompatible | mpl-no-copyleft-exception | exhibit b incompatible with secondary licenses notice
licenses this file to you under the mozilla | mpl | licenses this file to you under the mozilla public license
netscape public license | npl | netscape public license(?: version)?(?: 1 [01])?(?: npl)?
eclipse distribution | edl | eclipse distribution license(?: v| version)?(?: 1 0)?
secondary licenses are | epl | secondary licenses are (?:the )?gnu general public license version 2
sun public license | spl | (?:the )?sun public license(?: version)?(?: 1 0)?
sun industry standards | sissl | sun industry standards source license(?: version)?(?: 1 [12])?
ibm public license | ipl | ibm public license(?: version)?(?: 1 0)?
lucent public license | lpl | lucent public license(?: version)?(?: 1 0 2| 1 02)?
reciprocal public license | rpl | reciprocal public license(?: version)?(?: 1 [15])?
apple public source | apsl | apple public source license(?: version)?(?: [12] [0-2])?
nokia open source | nokia | nokia open source license(?: version)?(?: 1 0a)?
intel open source | intel | intel open source license
zope public license | zpl | zope public license(?: zpl)?(?: version)?(?: [12] [01])?
cecill | cecill | (?:under the )?cecill(?: [bc])?(?: free software)?(?: licen[cs]e)?(?: agreement)?
licence libre du quebec | liliq | licence libre du quebec(?: permissive| reciprocite)?
gnu all permissive | fsfap | gnu all permissive licen[cs]e
copying and distribution of this file | fsfap | copying and distribution of this file with or without modification are permitted in any medium without royalty
imlib2 | imlib2 | imlib2 licen[cs]e
info zip | info-zip | info zip licen[cs]e
png | libpng | (?:the )?(?:png reference library|libpng) licen[cs]e(?: version)?(?: 2 0| 2)?
libtiff | libtiff | libtiff licen[cs]e
independent jpeg group | ijg | this software is based in part on the work of the independent jpeg group
freetype project | ftl | (?:the )?freetype project licen[cs]e
portions of this software are copyright | ftl | portions of this software are copyright [^ ]+ the freetype project
bzip2 | bzip2 | bzip2(?: and libbzip2)? licen[cs]e
sqlite blessing | blessing | sqlite blessing
author disclaims copyright to this source | blessing | the author disclaims copyright to this source code
may you do good and not evil | blessing | may you do good and not evil
anti 996 | anti-996 | anti 996 licen[cs]e(?: version)?(?: 1 0)?
hippocratic | hippocratic | hippocratic licen[cs]e(?: version)?(?: [123] [01])?
parity public license | parity | parity public license(?: [67] 0 0)?
prosperity public license | prosperity | prosperity public license(?: 3 0 0)?
blue oak model | blueoak | blue oak model license(?: 1 0 0)?
cern open hardware | cern-ohl | cern open hardware licen[cs]e(?: version)?(?: [12])?(?: (?:strongly|weakly) reciprocal| permissive)?
solderpad | solderpad | solderpad hardware licen[cs]e(?: v| version)?(?: 2 [01])?
tapr open hardware | tapr-ohl | tapr open hardware licen[cs]e
free art license | lal | free art license(?: 1 [23])?
licence art libre | lal | licence art libre(?: 1 [23])?
design science license | dsl | design science license
open publication license | opl | open publication license(?: v| version)?(?: 1 0)?
open content license | opencontent | open content license
open software license v | osl | open software license v ?[123] [0-2]
educational community | ecl | educational community license(?: version)?(?: [12] 0)?
university of illinois | ncsa | university of illinois ncsa open source license
nasa open source | nasa | nasa open source agreement(?: version)?(?: 1 3)?
open logistics | open-logistics | open logistics (?:foundation )?licen[cs]e(?: version)?(?: 1 3)?
community data license | cdla | community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?
open data commons | odc | open data commons(?: open database| attribution| public domain dedication)? licen[cs]e
open database license | odbl | open database license(?: odbl)?(?: v)?(?: 1 0)?
data licence germany | dl-de | data licence germany(?: attribution| zero)?(?: version)?(?: 2 0)?
datenlizenz deutschland | dl-de | datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?
crown copyright | ogl-uk | crown copyright(?: and database rights?)?
norwegian | nlod | norwegian licen[cs]e for open government data nlod
exclusive royalty free | royalty-free | non ?exclusive royalty free(?: worldwide| perpetual| irrevocable)* licen[cs]e
royalty free | royalty-free | (?:worldwide|perpetual|irrevocable) royalty free(?: worldwide| perpetual| irrevocable| non exclusive)* licen[cs]e
responsible ai license | openrail | responsible ai license(?:s)?(?: rail)?
use based restrictions | openrail | use based restrictions(?: as referenced in paragraph 5)?
llama materials | llama | (?:the )?llama materials
acceptable use policy | aup | (?:the )?[^ ]+ acceptable use policy
research purposes only | non-commercial | (?:for )?(?:non commercial )?research purposes only
evaluation purposes only | evaluation | (?:for )?(?:internal )?evaluation purposes only
internal use only | proprietary | (?:for )?internal use only
trade secret | proprietary | (?:valuable |confidential )?trade secrets? of [^ ]+
not for redistribution | proprietary | not for redistribution
subscription agreement | proprietary | (?:terms of the|under (?:the|a)) (?:[^ ]+ ){0,3}?subscription agreement
terms of service | terms-of-service | (?:subject to|governed by) (?:the |our |these )?terms of service
"""
#: Statements that suppress the license that they name: keyword, words.
DENIALS = """
not | (?:is|are|was) not (?:licen[cs]ed|released|distributed|available|covered|published) under (?:the |an? )?(?:[^ ]+ ){1,6}?licen[cs]e
no longer | no longer (?:licen[cs]ed|released|distributed|available|covered) under (?:the |an? )?(?:[^ ]+ ){1,6}?licen[cs]e
compatible with | (?:in|not )compatible with (?:the )?(?:[^ ]+ ){1,6}?licen[cs]e
unlike | unlike the (?:[^ ]+ ){1,4}?licen[cs]e
instead of | instead of the (?:[^ ]+ ){1,4}?licen[cs]e
"""
DENIED = "-"
VERSION = r"(?: version| v)?(?: v?[0-9]+(?: [0-9]+)?)?(?: or (?:any )?later(?: version)?)?"
UNDER = r"(?:released|licensed|used|distributed|available|provided|published|offered|shared|covered|redistributed|dual licensed|sublicensed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: Tiers from strong to weak.
IDENTIFIED, NOTICED, TITLED, GENERIC = range(4)
CONFIDENCE = (0.99, 0.95, 0.9, 0.5)
#: A text that holds none of these is scanned for some of the notices only.
KEYWORDS = ("licen", "public domain", "spdx", "all rights reserved", "(?:d|available) under ")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_RULE = f"(?<= )(?:{'|'.join(BASE)})(?= )"
MARK = "\u0001"


def lines(table: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, tier) in order. Patterns match whole words of a text with single spaces around each word."""
    out = [(DENIED, key, words, IDENTIFIED) for key, words in lines(DENIALS)]
    out += [(label, key, words, IDENTIFIED) for key, label, words in lines(NOTICES)]
    for label, names in FAMILIES.items():
        short = names[0]
        spdx = rf"{short}(?: [0-9]+(?: [0-9]+)?)?(?: or later| only)?(?: with [^ ]+(?: [^ ]+)? exception(?: [0-9] [0-9])?)?"
        out.append((label, "spdx", rf"spdx license identifier {spdx}", IDENTIFIED))
        out.append((label, "spdx", rf"(?<=spdx license identifier [^ ]{{1,20}} ?[0-9]{{0,2}} ?[0-9]{{0,2}} (?:and|or) ){spdx}", IDENTIFIED))
        out.append((label, f"license {short}", rf"(?<!this )(?<!the )license {short}{VERSION}(?: license)?", TITLED))
    for label, names in FAMILIES.items():
        for name in names:
            out.append((label, f" {name} ", rf"{UNDER}{name}(?: international)?(?: public)?(?: licen[cs]e)?{VERSION}", NOTICED))
            out.append((label, f" {name} ", rf"{name} (?:public )?licen[cs]e[ds]?{VERSION}", TITLED))
    out.append(("other", "licen", rf"{UNDER}(?:a|an|the|this) [^ ]+ licen[cs]e", GENERIC))
    return [(label, key, f"(?<= ){pattern}(?= )", tier) for label, key, pattern, tier in out]


def notices() -> list[tuple[str, str, str, int]]:
    """Those of the rules that can match a text without KEYWORDS: notices whose keyword holds none of them. All others name a license, or
    something that is licensed or available under one."""
    own = {(label, key, f"(?<= ){words}(?= )") for key, label, words in lines(NOTICES) if not any(k in key for k in KEYWORDS[:4])}
    return [r for r in rules() if r[:3] in own and r[3] == IDENTIFIED]


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """Start (word, from 0) and text of each match, left to right; linear in the text."""
    marked = F.split(F.trim(F.regexp_replace(words, pattern, F.lit(f"{MARK}$0"))), " ")
    starts = F.filter(F.transform(marked, lambda w, k: F.when(F.startswith(w, F.lit(MARK)), k.cast("long"))), lambda k: k.isNotNull())
    return F.arrays_zip(starts.alias("start"), F.regexp_extract_all(words, pattern, F.lit(0)).alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score, row by row.

    A null text is empty: no words, no labels (empty strings), score 0. Score: the confidence of the strongest match left.
    """
    table = {k: [F.struct(F.lit(a).alias("label"), F.lit(k).alias("key"), F.lit(p).alias("pattern"), F.lit(t).alias("tier")) for a, k, p, t in some] for k, some in (("all", rules()), ("notices", notices()))}
    text = F.coalesce("text", F.lit(""))
    lower = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))  # A-Z only
    low = docs.withColumn("_body", F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))
    low = low.withColumn("_words", F.concat(F.lit(" "), F.col("_body"), F.lit(" ")))
    words = F.col("_words")
    keys = F.array(*(F.lit(key) for key in dict.fromkeys(key for _, key, *_ in notices())))
    base = low.withColumn("_base", F.when(F.contains(words, F.lit(" license ")), places(words, F.lit(BASE_RULE))).otherwise(F.expr("cast(array() as array<struct<start:bigint,text:string>>)")))
    base = base.withColumn("_keys", F.when(words.rlike("|".join(KEYWORDS)), F.lit(None)).otherwise(F.filter(keys, lambda key: F.contains(words, key))))
    of_notices = F.when(F.size("_keys") > 0, F.filter(F.array(*table["notices"]), lambda r: F.array_contains("_keys", r["key"])))
    base = base.withColumn("_rules", F.when(F.col("_keys").isNull(), F.filter(F.array(*table["all"]), lambda r: F.contains(words, r["key"]))).otherwise(of_notices))

    def detections(r: Column) -> Column:
        return F.transform(places(words, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), (-m["start"] - spaces(m["text"])).alias("minus_end"), r["tier"].alias("tier"), r["label"].alias("label")))

    found = base.withColumn("_found", F.when(F.size("_rules") > 0, F.sort_array(F.flatten(F.transform("_rules", detections)))))
    # From left to right, longer before shorter: inside an earlier one means that its end is not beyond the furthest end so far.
    state = "named_struct('ends', array(-1L, -1L, -1L, -1L), 'labels', cast(array() as array<string>), 'tier', 9)"
    step = """(s, d) -> if(array_max(slice(s.ends, 1, d.tier + 1)) >= -d.minus_end, s, named_struct(
        'ends', transform(s.ends, (e, k) -> if(k = d.tier, greatest(e, -d.minus_end), e)),
        'labels', array_union(s.labels, if(d.tier = 3 or d.label = '-', cast(array() as array<string>), array(d.label))),
        'tier', if(d.label = '-', s.tier, least(s.tier, d.tier))))"""
    kept = found.withColumn("_kept", F.expr(f"aggregate(coalesce(_found, cast(array() as array<struct<start:bigint,minus_end:bigint,tier:int,label:string>>)), {state}, {step})"))
    names = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    kept = kept.withColumn("_labels", F.array_sort(F.array_distinct(F.transform("_base", lambda m: names[m["text"]]))))
    own = F.when((F.size("_kept.labels") == 0) & (F.size("_labels") == 0) & (F.col("_kept.tier") == GENERIC), F.array(F.lit("other"))).otherwise(F.col("_kept.labels"))
    score = F.coalesce(F.try_element_at(F.array(*map(F.lit, CONFIDENCE)), F.least(F.col("_kept.tier"), F.when(F.size("_base") > 0, TITLED)) + 1), F.lit(0.0))
    return kept.select(
        *docs.columns,
        F.when(F.col("_body") == "", F.lit(0)).otherwise(spaces(F.col("_body")) + 1).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda m: m["start"])).alias("last_word"),
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_labels", own)), ",").alias("labels"),
        score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op4_licenses": query}
