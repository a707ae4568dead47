"""Signature rules of license notices, written one by one.

A line is ``label = pattern`` over normalised words (A-Z lower-cased, anything
but letters, digits and characters beyond ASCII is a break, words are joined by
single spaces). Patterns are regular expressions without captures; ``?`` after
a space and a word makes that word optional. Of detections that lie within one
another, the higher priority wins, then the longer one.
"""

from __future__ import annotations

#: Priority 5: identifiers, and sentences that stand in a license's own text.
OWN_TEXT = r"""
mit = spdx license identifier mit(?: 0)?
apache-2 = spdx license identifier apache 2 0
apache-1.1 = spdx license identifier apache 1 1
gpl-1 = spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 = spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 = spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 = spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 = spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 = spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 = spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.2 = spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 = spdx license identifier gfdl 1 3(?: only| or later)?
bsd-1 = spdx license identifier bsd 1 clause
bsd-2 = spdx license identifier bsd 2 clause(?: patent)?
bsd-3 = spdx license identifier bsd 3 clause(?: clear)?
bsd-4 = spdx license identifier bsd 4 clause
bsd-0 = spdx license identifier 0bsd
mpl-1.1 = spdx license identifier mpl 1 1
mpl-2 = spdx license identifier mpl 2 0
epl-1 = spdx license identifier epl 1 0
epl-2 = spdx license identifier epl 2 0
cddl-1 = spdx license identifier cddl 1 [01]
cpl-1 = spdx license identifier cpl 1 0
isc = spdx license identifier isc
zlib = spdx license identifier zlib
unlicense = spdx license identifier unlicense
boost-1 = spdx license identifier bsl 1 0
busl-1.1 = spdx license identifier busl 1 1
artistic-1 = spdx license identifier artistic 1 0
artistic-2 = spdx license identifier artistic 2 0
eupl-1.1 = spdx license identifier eupl 1 1
eupl-1.2 = spdx license identifier eupl 1 2
ofl-1.1 = spdx license identifier ofl 1 1
wtfpl = spdx license identifier wtfpl
ms-pl = spdx license identifier ms pl
ms-rl = spdx license identifier ms rl
psf-2 = spdx license identifier psf 2 0
postgresql = spdx license identifier postgresql
odbl-1 = spdx license identifier odbl 1 0
pddl-1 = spdx license identifier pddl 1 0
odc-by-1 = spdx license identifier odc by 1 0
cecill-2.1 = spdx license identifier cecill 2 1
cecill-b = spdx license identifier cecill b
cecill-c = spdx license identifier cecill c
afl-3 = spdx license identifier afl 3 0
osl-3 = spdx license identifier osl 3 0
sspl-1 = spdx license identifier sspl 1 0
elastic-2 = spdx license identifier elastic 2 0
upl-1 = spdx license identifier upl 1 0
ncsa = spdx license identifier ncsa
vim = spdx license identifier vim
openssl = spdx license identifier openssl
ruby = spdx license identifier ruby
php-3.01 = spdx license identifier php 3 01
cc0 = spdx license identifier cc0 1 0
cc-by = spdx license identifier cc by [1-4] [05]
cc-by-sa = spdx license identifier cc by sa [1-4] [05]
cc-by-nd = spdx license identifier cc by nd [1-4] [05]
cc-by-nc = spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa = spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd = spdx license identifier cc by nc nd [1-4] [05]
mit = permission is hereby granted free of charge to any person obtaining a copy of this software
mit = the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit = the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc = permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-0 = permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-3 = redistribution and use in source and binary forms with or without modification are permitted
bsd-3 = neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4 = all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2 = redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2 = you may not use this file except in compliance with the license
apache-2 = unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 = www apache org licenses license 2 0
gpl-2 = this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3 = this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
lgpl-2.1 = this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2 = this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license
agpl-3 = you should have received a copy of the gnu affero general public license
lgpl = you should have received a copy of the gnu lesser general public license
gpl = you should have received a copy of the gnu general public license
mpl-2 = this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 = the contents of this file are subject to the mozilla public license version 1 1
mpl-2 = if a copy of the mpl was not distributed with this file you can obtain one at
epl-1 = this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 = this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
unlicense = this is free and unencumbered software released into the public domain
unlicense = anyone is free to copy modify publish use compile sell or distribute this software
zlib = this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib = altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1 = permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
wtfpl = you just do what the fuck you want to
artistic-2 = everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms
ofl-1.1 = this font software is licensed under the sil open font license
cc0 = to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights
postgresql = permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
gfdl-1.3 = permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 = permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
upl-1 = the universal permissive license upl version 1 0
beerware = as long as you retain this notice you can do whatever you want with this stuff
openssl = this product includes software developed by the openssl project for use in the openssl toolkit
ncsa = redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
php-3.01 = this product includes php software freely available from
vim = you may distribute unmodified copies of vim without restrictions
busl-1.1 = the business source license this document or the license is not an open source license
elastic-2 = you may not provide the software to third parties as a hosted or managed service
json = the software shall be used for good not evil
"""

#: Priority 4: statements that grant a license by its name.
GRANTS = r"""
mit = (?:licensed|released|distributed|published|available|provided|covered|offered) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11)(?: licen[sc]e)?
apache-2 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?
apache-1.1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?1 1
apache = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e
gpl-2 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
gpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
gpl-2 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:gnu )?gplv2
gpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:gnu )?gplv3
gpl = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)
lgpl-2 = (?:licensed|released|distributed|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:library general public|lgpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
lgpl-2.1 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:(?:lesser|library) general public|lgpl)(?: licen[sc]e)?(?: version)? v?2 1
lgpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public|lgpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
lgpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:gnu )?lgplv3
lgpl = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl)
agpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public|agpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
agpl-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:gnu )?agplv3
gfdl-1.3 = (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?gnu free documentation(?: licen[sc]e)?(?: version)? 1 3
gfdl = (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu free documentation licen[sc]e|gfdl)
bsd-2 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: licen[sc]e)?
bsd-3 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
bsd-4 = (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?
bsd = (?:licensed|released|distributed|published|available|provided|covered) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)?(?: licen[sc]e)?
mpl-1.1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:mozilla public|mpl)(?: licen[sc]e)?(?: version)? v?1 1
mpl-2 = (?:licensed|released|distributed|published|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:mozilla public|mpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
epl-1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:eclipse public|epl)(?: licen[sc]e)?(?: version)? v?1(?: 0)?
epl-2 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:eclipse public|epl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
cddl-1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:common development and distribution|cddl)(?: licen[sc]e)?(?: version)? v?1(?: [01])?
cpl-1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?common public(?: licen[sc]e)?(?: version)? v?1(?: 0)?
isc = (?:licensed|released|distributed|published|available|covered) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[sc]e)?
zlib = (?:licensed|released|distributed|published|available|covered) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: licen[sc]e)?
unlicense = (?:licensed|released|distributed|published|available|covered) under (?:the )?(?:terms of )?(?:the )?unlicense
boost-1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?boost(?: software)?(?: licen[sc]e)?(?: version)?(?: 1(?: 0)?)?
busl-1.1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?business source(?: licen[sc]e)?(?: version)?(?: 1 1)?
artistic-1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic(?: licen[sc]e)?(?: version)? v?1(?: 0)?
artistic-2 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?artistic(?: licen[sc]e)?(?: version)? v?2(?: 0)?
perl = (?:redistribute it and or modify it|available|licensed) under the same terms as perl(?: itself)?
eupl-1.2 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:european union public|eupl)(?: licen[sc]e)?(?: version)? v?1 2
ofl-1.1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:sil open font|ofl)(?: licen[sc]e)?(?: version)? v?1 1
ofl-1.1 = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?sil open font licen[sc]e
wtfpl = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:wtfpl|do what the fuck you want to public licen[sc]e)
ms-pl = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?microsoft public(?: licen[sc]e)?
ms-rl = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?microsoft reciprocal(?: licen[sc]e)?
psf-2 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:python software foundation|psf)(?: licen[sc]e)?(?: version)?(?: 2(?: 0)?)?
postgresql = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?postgresql(?: licen[sc]e)?
odbl-1 = (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:open (?:data commons open )?database|odbl)(?: licen[sc]e)?(?: v?1(?: 0)?)?
pddl-1 = (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?public domain dedication and licen[sc]e
cecill-2.1 = (?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?cecill(?: free software)?(?: licen[sc]e)?(?: version)? v?2 1
cecill = (?:licensed|released|distributed|available|governed|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?cecill(?: licen[sc]e)?
afl-3 = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:academic free|afl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
osl-3 = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:open software|osl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
sspl-1 = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:server side public licen[sc]e|sspl)
elastic-2 = (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?elastic licen[sc]e(?: version)?(?: v?2(?: 0)?)?
cc0 = (?:licensed|released|distributed|published|available|dedicated) under (?:the )?(?:terms of )?(?:the )?(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?
cc-by = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by(?: v?[1-4] [05])?
cc-by-sa = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by sa(?: v?[1-4] [05])?
cc-by-nd = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by nd(?: v?[1-4] [05])?
cc-by-nc = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by nc(?: v?[1-4] [05])?
cc-by-nc-sa = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by nc sa(?: v?[1-4] [05])?
cc-by-nc-nd = (?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by nc nd(?: v?[1-4] [05])?
mit = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11)(?: licen[sc]e)?
apache-2 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?
gpl-2 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
gpl-3 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public|gpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
lgpl-2.1 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:(?:lesser|library) general public|lgpl)(?: licen[sc]e)?(?: version)? v?2 1
lgpl-3 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public|lgpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
agpl-3 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public|agpl)(?: licen[sc]e)?(?: version)? v?3(?: 0)?
bsd-2 = (?:subject to|governed by|in accordance with) (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?
bsd-3 = (?:subject to|governed by|in accordance with) (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?
bsd = (?:subject to|governed by) (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[sc]e
mpl-2 = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?(?:mozilla public|mpl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
epl-2 = (?:subject to|governed by|in accordance with) (?:the )?(?:terms of )?(?:the )?(?:eclipse public|epl)(?: licen[sc]e)?(?: version)? v?2(?: 0)?
cddl-1 = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?(?:common development and distribution|cddl)(?: licen[sc]e)?(?: version)? v?1(?: [01])?
isc = (?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?isc(?: licen[sc]e)?
zlib = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: licen[sc]e)?
boost-1 = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?boost software(?: licen[sc]e)?(?: version)?(?: 1(?: 0)?)?
unlicense = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?unlicense
ms-pl = (?:subject to|governed by|in accordance with) (?:the )?(?:terms of )?(?:the )?microsoft public(?: licen[sc]e)?
psf-2 = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?python software foundation(?: licen[sc]e)?(?: version)?(?: 2(?: 0)?)?
odbl-1 = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?open (?:data commons open )?database(?: licen[sc]e)?
eupl-1.2 = (?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?(?:european union public|eupl)(?: licen[sc]e)?(?: version)? v?1 2
cc-by = (?:subject to|governed by) (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by(?: v?[1-4] [05])?
cc-by-sa = (?:subject to|governed by) (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by sa(?: v?[1-4] [05])?
cc-by-nc = (?:subject to|governed by) (?:the |a )?(?:terms of )?(?:the )?(?:creative commons|cc) by nc(?: v?[1-4] [05])?
mit = (?:dual|also|jointly) licensed (?:under )?(?:the )?mit(?: licen[sc]e)?
apache-2 = (?:dual|also|jointly) licensed (?:under )?(?:the )?apache(?: licen[sc]e)?(?: version)? v?2(?: 0)?
gpl-2 = (?:dual|also|jointly) licensed (?:under )?(?:the )?(?:gnu )?gpl(?: version)? v?2
gpl-3 = (?:dual|also|jointly) licensed (?:under )?(?:the )?(?:gnu )?gpl(?: version)? v?3
bsd = (?:dual|also|jointly) licensed (?:under )?(?:the )?bsd(?: licen[sc]e)?
mpl-2 = (?:dual|also|jointly) licensed (?:under )?(?:the )?(?:mozilla public licen[sc]e|mpl)(?: version)? v?2(?: 0)?
public-domain = (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
public-domain = (?:this (?:work|file|code|software|text)|it) is (?:hereby )?in the public domain
proprietary = (?:proprietary and confidential|confidential and proprietary)
proprietary = unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|work|software|document)(?: via any medium)? is strictly prohibited
proprietary = no part of this (?:publication|work|document|book) may be reproduced
all-rights-reserved = copyright (?:c )?(?:19|20)[0-9][0-9] .{1,60} all rights reserved
"""

#: Priority 3: a license named as one.
NAMES = r"""
mit = (?:mit|expat|x11) licen[sc]ed?
apache-2 = apache(?: software)? licen[sc]ed?(?: version)? v?2(?: 0)?
apache-2 = apache v?2(?: 0)? licen[sc]ed?
apache-1.1 = apache(?: software)? licen[sc]e(?: version)? v?1 1
apache = apache(?: software)? licen[sc]ed?
gpl-2 = gnu general public licen[sc]e(?: version)? v?2(?: 0)?
gpl-2 = gpl ?v?2(?: 0)? licen[sc]ed?
gpl-2 = gplv2(?: only| or later)?
gpl-3 = gnu general public licen[sc]e(?: version)? v?3(?: 0)?
gpl-3 = gpl ?v?3(?: 0)? licen[sc]ed?
gpl-3 = gplv3(?: only| or later)?
gpl = gnu general public licen[sc]e
gpl = gpl licen[sc]ed?
lgpl-2.1 = gnu (?:lesser|library) general public licen[sc]e(?: version)? v?2 1
lgpl-2.1 = lgpl ?v?2 1(?: licen[sc]ed?)?
lgpl-3 = gnu lesser general public licen[sc]e(?: version)? v?3(?: 0)?
lgpl-3 = lgplv3(?: only| or later)?
lgpl = gnu (?:lesser|library) general public licen[sc]e
lgpl = lgpl licen[sc]ed?
agpl-3 = gnu affero general public licen[sc]e(?: version)?(?: v?3(?: 0)?)?
agpl-3 = agplv3(?: only| or later)?
agpl = agpl licen[sc]ed?
gfdl = gnu free documentation licen[sc]e
bsd-2 = (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) licen[sc]ed?
bsd-3 = (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]ed?
bsd-4 = (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]ed?
bsd = bsd(?: style)? licen[sc]ed?
mpl-1.1 = mozilla public licen[sc]e(?: version)? v?1 1
mpl-2 = mozilla public licen[sc]e(?: version)? v?2(?: 0)?
mpl = mozilla public licen[sc]e
epl-1 = eclipse public licen[sc]e(?: version)? v?1(?: 0)?
epl-2 = eclipse public licen[sc]e(?: version)? v?2(?: 0)?
epl = eclipse public licen[sc]e
cddl-1 = common development and distribution licen[sc]e
cpl-1 = common public licen[sc]e
isc = isc licen[sc]ed?
zlib = zlib(?: libpng)? licen[sc]ed?
unlicense = the unlicense
boost-1 = boost software licen[sc]e
busl-1.1 = business source licen[sc]e
artistic-2 = artistic licen[sc]e(?: version)? v?2(?: 0)?
artistic = artistic licen[sc]e
eupl-1.2 = european union public licen[sc]e(?: version)? v?1 2
eupl = european union public licen[sc]e
ofl-1.1 = sil open font licen[sc]e
wtfpl = wtfpl licen[sc]ed?
ms-pl = microsoft public licen[sc]e
ms-rl = microsoft reciprocal licen[sc]e
psf-2 = python software foundation licen[sc]e
postgresql = postgresql licen[sc]e
odbl-1 = open (?:data commons open )?database licen[sc]e
odc-by-1 = open data commons attribution licen[sc]e
pddl-1 = public domain dedication and licen[sc]e
cecill = cecill(?: free software)? licen[sc]e
afl-3 = academic free licen[sc]e
osl-3 = open software licen[sc]e
sspl-1 = server side public licen[sc]e
elastic-2 = elastic licen[sc]e
upl-1 = universal permissive licen[sc]e
ncsa = (?:university of illinois )?ncsa open source licen[sc]e
vim = vim licen[sc]e
openssl = openssl licen[sc]e
ruby = ruby licen[sc]e
php-3.01 = php licen[sc]e
beerware = beer ?ware licen[sc]e
cc0 = (?:creative commons zero|cc0|cc zero)(?: 1 0)?(?: universal)? (?:licen[sc]e|public domain dedication)
cc-by = (?:creative commons|cc) by(?: v?[1-4] [05])? licen[sc]ed?
cc-by-sa = (?:creative commons|cc) by sa(?: v?[1-4] [05])? licen[sc]ed?
cc-by-nd = (?:creative commons|cc) by nd(?: v?[1-4] [05])? licen[sc]ed?
cc-by-nc = (?:creative commons|cc) by nc(?: v?[1-4] [05])? licen[sc]ed?
cc-by-nc-sa = (?:creative commons|cc) by nc sa(?: v?[1-4] [05])? licen[sc]ed?
cc-by-nc-nd = (?:creative commons|cc) by nc nd(?: v?[1-4] [05])? licen[sc]ed?
cc-by = creative commons attribution(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by-sa = creative commons attribution share ?alike(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by-nd = creative commons attribution no ?deriv(?:ative|ativ)?e?s(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by-nc = creative commons attribution non ?commercial(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by-nc-sa = creative commons attribution non ?commercial share ?alike(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd = creative commons attribution non ?commercial no ?deriv(?:ative|ativ)?e?s(?: v?[1-4] [05])?(?: international| unported| generic)?
cc-by = creativecommons org licenses by [1-4] [05]
cc-by-sa = creativecommons org licenses by sa [1-4] [05]
cc-by-nd = creativecommons org licenses by nd [1-4] [05]
cc-by-nc = creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa = creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd = creativecommons org licenses by nc nd [1-4] [05]
cc0 = creativecommons org publicdomain zero 1 0
gpl = gnu org licenses gpl(?: [23] 0)?
lgpl = gnu org licenses lgpl(?: (?:2 1|3 0))?
agpl-3 = gnu org licenses agpl(?: 3 0)?
mit = opensource org licenses mit
bsd-3 = opensource org licenses bsd 3 clause
bsd-2 = opensource org licenses bsd 2 clause
mpl-2 = mozilla org mpl 2 0
all-rights-reserved = all rights reserved
"""

#: Priority 2: a license mentioned in a field or list.
MENTIONS = r"""
mit = licen[sc]es? (?:is )?(?:the )?mit
apache-2 = licen[sc]es? (?:is )?(?:the )?apache 2(?: 0)?
gpl-2 = licen[sc]es? (?:is )?(?:the )?(?:gnu )?gpl v?2(?: 0)?
gpl-3 = licen[sc]es? (?:is )?(?:the )?(?:gnu )?gpl v?3(?: 0)?
gpl = licen[sc]es? (?:is )?(?:the )?(?:gnu )?gpl
lgpl-2.1 = licen[sc]es? (?:is )?(?:the )?(?:gnu )?lgpl v?2 1
lgpl-3 = licen[sc]es? (?:is )?(?:the )?(?:gnu )?lgpl v?3(?: 0)?
agpl-3 = licen[sc]es? (?:is )?(?:the )?(?:gnu )?agpl(?: v?3(?: 0)?)?
bsd-2 = licen[sc]es? (?:is )?(?:the )?bsd 2 clause
bsd-3 = licen[sc]es? (?:is )?(?:the )?bsd 3 clause
bsd = licen[sc]es? (?:is )?(?:the )?bsd
mpl-2 = licen[sc]es? (?:is )?(?:the )?mpl v?2(?: 0)?
epl-2 = licen[sc]es? (?:is )?(?:the )?epl v?2(?: 0)?
isc = licen[sc]es? (?:is )?(?:the )?isc
zlib = licen[sc]es? (?:is )?(?:the )?zlib
unlicense = licen[sc]es? (?:is )?(?:the )?unlicense
boost-1 = licen[sc]es? (?:is )?(?:the )?bsl 1 0
wtfpl = licen[sc]es? (?:is )?(?:the )?wtfpl
ms-pl = licen[sc]es? (?:is )?(?:the )?ms pl
cc0 = licen[sc]es? (?:is )?(?:the )?cc0(?: 1 0)?
cc-by = licen[sc]es? (?:is )?(?:the )?cc by(?: v?[1-4] [05])?
cc-by-sa = licen[sc]es? (?:is )?(?:the )?cc by sa(?: v?[1-4] [05])?
cc-by-nd = licen[sc]es? (?:is )?(?:the )?cc by nd(?: v?[1-4] [05])?
cc-by-nc = licen[sc]es? (?:is )?(?:the )?cc by nc(?: v?[1-4] [05])?
cc-by-nc-sa = licen[sc]es? (?:is )?(?:the )?cc by nc sa(?: v?[1-4] [05])?
cc-by-nc-nd = licen[sc]es? (?:is )?(?:the )?cc by nc nd(?: v?[1-4] [05])?
proprietary = licen[sc]es? (?:is )?(?:the )?proprietary
"""

#: (priority, lines)
SECTIONS = ((5, OWN_TEXT), (4, GRANTS), (3, NAMES), (2, MENTIONS))


def written() -> list[tuple[str, int, str]]:
    """(label, priority, pattern) of every rule, in the order above."""
    return [(*(x.strip() for x in line.split(" = ", 1)[:1]), priority, line.split(" = ", 1)[1].strip()) for priority, text in SECTIONS for line in text.strip().splitlines()]
