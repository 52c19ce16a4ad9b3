"""The signatures of license scans: keyword, expression, label, priority and weight of each.

Rules are written by hand, one line each: ``label ; keyword ; expression``. They stand in order of priority: grants and sentences that
only one license has, then names with versions, then names alone, then notices. In an expression a blank stands for any run of white
space and comment signs, and ``license`` for both spellings. Every match contains its keyword, in lower case, and something that GATE finds.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    """A signature. ``keyword`` (lower case) must occur before ``pattern`` is tried; a lower priority number is stronger."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: Grants, sentences and addresses of one license.
GRANTS = r"""
apache-2.0 ; apache ; licensed under the apache license,? version 2\.0
apache-2.0 ; apache.org ; apache\.org/licenses/license-2\.0
apache-2.0 ; apache ; licensed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 ; compliance ; you may not use this file except in compliance with the license
apache-2.0 ; warranties ; distributed on an .{0,3}as is.{0,3} basis, without warranties or conditions of any kind
apache-2.0 ; perpetual ; grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
apache-1.1 ; apache ; this product includes software developed by the apache software foundation[^.]{0,80}apache license 1\.1
apache-1.1 ; apache ; the names .{0,3}apache.{0,3} and .{0,3}apache software foundation.{0,3} must not be used to endorse[^.]{0,120}without prior written permission
mit ; permission ; permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit ; substantial ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit ; warranty ; the software is provided .{0,3}as is.{0,3}, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
mit-0 ; permission ; permission is hereby granted, free of charge[^.]{0,300}without restriction[^.]{0,200}to whom the software is furnished to do so\. the software is provided
isc ; permission ; permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
0bsd ; permission ; permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
isc ; warranties ; the author disclaims all warranties with regard to this software including all implied warranties
bsd ; redistribution ; redistribution and use in source and binary forms, with or without modification, are permitted
bsd ; redistributions ; redistributions of source code must retain the above copyright notice
bsd ; redistributions ; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause ; endorse ; neither the names? of [^.]{1,120}nor the names of [^.]{1,80}contributors may be used to endorse or promote products[^.]{0,80}without specific prior written permission
bsd-4-clause ; advertising ; all advertising materials mentioning features or use of this software must display[^.]{0,80}acknowledge?ment[^.]{0,300}(?:copyright|permission|license)
bsd-4-clause ; warranties ; this product includes software developed by the university of california, berkeley[^.]{0,200}warranties
bsd-source-code ; redistributions ; redistributions of source code must retain the above copyright notice immediately at the beginning of the file
gpl-1.0-or-later ; general public license ; gnu general public license[^.]{0,60}version 1,? or \(at your option\) any later version
gpl-2.0-or-later ; general public license ; (?:gnu )?general public license[^.]{0,60}(?:version 2|v2)(?:\.0)?(?: of the license)?,? or (?:\(at your option\) )?any later version
gpl-2.0-or-later ; free software foundation ; either version 2 of the license, or \(at your option\) any later version[^.]{0,40}free software foundation
gpl-3.0-or-later ; general public license ; (?:gnu )?general public license[^.]{0,60}(?:version 3|v3)(?:\.0)?(?: of the license)?,? or (?:\(at your option\) )?any later version
gpl-3.0-or-later ; license ; either version 3 of the license,? or \(at your option\) any later version
gpl-2.0-or-later ; license ; either version 2 of the license,? or \(at your option\) any later version
lgpl-2.1-or-later ; license ; either version 2\.1 of the license,? or \(at your option\) any later version
lgpl-2.1-or-later ; lesser general public license ; lesser general public license[^.]{0,60}(?:version 2\.1|v2\.1)(?: of the license)?,? or (?:\(at your option\) )?(?:any )?later
lgpl-3.0-or-later ; lesser general public license ; lesser general public license[^.]{0,60}(?:version 3|v3)(?:\.0)?(?: of the license)?,? or (?:\(at your option\) )?(?:any )?later
lgpl-2.0-or-later ; library general public license ; library general public license[^.]{0,60}version 2(?: of the license)?,? or (?:\(at your option\) )?any later version
agpl-3.0-or-later ; affero general public license ; affero general public license[^.]{0,60}(?:version 3|v3)(?:\.0)?(?: of the license)?,? or (?:\(at your option\) )?any later version
gfdl-1.1-or-later ; free documentation license ; free documentation license,? version 1\.1 or any later version
gfdl-1.2-or-later ; free documentation license ; free documentation license,? version 1\.2 or any later version
gfdl-1.3-or-later ; free documentation license ; free documentation license,? version 1\.3 or any later version
gpl ; redistribute ; this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public license
gpl ; general public license ; you should have received a copy of the gnu general public license along with this program
lgpl ; redistribute ; this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu lesser general public license
lgpl ; lesser general public license ; you should have received a copy of the gnu lesser general public license along with this library
agpl ; affero general public license ; you should have received a copy of the gnu affero general public license along with this program
gpl-3.0 ; gnu.org/licenses/gpl-3.0 ; gnu\.org/licenses/gpl-3\.0
gpl-2.0 ; gnu.org/licenses/old-licenses/gpl-2.0 ; gnu\.org/licenses/old-licenses/gpl-2\.0
lgpl-3.0 ; gnu.org/licenses/lgpl-3.0 ; gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 ; gnu.org/licenses/old-licenses/lgpl-2.1 ; gnu\.org/licenses/old-licenses/lgpl-2\.1
agpl-3.0 ; gnu.org/licenses/agpl-3.0 ; gnu\.org/licenses/agpl-3\.0
gpl-with-classpath-exception ; linking ; linking this library statically or dynamically with other modules is making a combined work[^.]{0,80}permission
gpl-with-classpath-exception ; classpath ; classpath exception[^.]{0,40}license|license[^.]{0,40}classpath exception
mpl-2.0 ; mozilla public license ; this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
mpl-2.0 ; mozilla.org ; mozilla\.org/(?:en-us/)?(?:mpl|foundation/licensing)/2\.0.{0,20}license|license.{0,60}mozilla\.org/mpl/2\.0
mpl-1.1 ; mozilla public license ; the contents of this file are subject to the mozilla public license version 1\.1
epl-2.0 ; eclipse public license ; made available under the terms of the eclipse public license,? (?:version |v\.? ?)?2\.0
epl-1.0 ; eclipse public license ; made available under the terms of the eclipse public license,? (?:version |v\.? ?)?1\.0
cddl-1.0 ; common development ; subject to the terms of the common development and distribution license[^.]{0,30}1\.0
bsl-1.0 ; boost software license ; distributed under the boost software license,? version 1\.0
bsl-1.0 ; boost.org ; boost\.org/license_1_0\.txt
unlicense ; public domain ; this is free and unencumbered software released into the public domain
unlicense ; unlicense.org ; unlicense\.org
wtfpl ; do what the ; do what the (?:fuck|hell|\S{4}) you want to public license
zlib ; arising ; in no event will the authors be held liable for any damages arising from the use of this software\. permission is granted
zlib ; misrepresented ; the origin of this software must not be misrepresented[^.;]{0,160}(?:permission|license|notice|copyright|you must not claim)
cc0-1.0 ; publicdomain/zero ; creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 ; waive ; to the extent possible under law[^.]{0,120}waived all copyright and related or neighbou?ring rights
cc-by-4.0 ; licenses/by/4.0 ; creativecommons\.org/licenses/by/4\.0
cc-by-3.0 ; licenses/by/3.0 ; creativecommons\.org/licenses/by/3\.0
cc-by-2.5 ; licenses/by/2.5 ; creativecommons\.org/licenses/by/2\.5
cc-by-2.0 ; licenses/by/2.0 ; creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 ; licenses/by-sa/4.0 ; creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 ; licenses/by-sa/3.0 ; creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.5 ; licenses/by-sa/2.5 ; creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-2.0 ; licenses/by-sa/2.0 ; creativecommons\.org/licenses/by-sa/2\.0
cc-by-nc-4.0 ; licenses/by-nc/4.0 ; creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 ; licenses/by-nc/3.0 ; creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-2.0 ; licenses/by-nc/2.0 ; creativecommons\.org/licenses/by-nc/2\.0
cc-by-nd-4.0 ; licenses/by-nd/4.0 ; creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 ; licenses/by-nd/3.0 ; creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-sa-4.0 ; licenses/by-nc-sa/4.0 ; creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 ; licenses/by-nc-sa/3.0 ; creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 ; licenses/by-nc-nd/4.0 ; creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 ; licenses/by-nc-nd/3.0 ; creativecommons\.org/licenses/by-nc-nd/3\.0
odbl-1.0 ; open database license ; made available under the open database license
ofl-1.1 ; open font license ; this font software is licensed under the sil open font license,? version 1\.1
artistic-2.0 ; artistic license ; free software[^.]{0,60}under the terms of the artistic license (?:version )?2\.0
perl ; perl itself ; under the same terms as perl itself[^.]{0,40}license|license[^.]{0,120}under the same terms as perl itself
ms-pl ; microsoft public license ; (?:subject to|licensed under|governed by) the (?:terms of the )?microsoft public license
psf-2.0 ; python software foundation ; python software foundation license(?: agreement)?(?:,? version 2)
postgresql ; written agreement ; permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
beerware ; beer ; the beer-?ware license
jsonlicense ; good, not evil ; the software shall be used for good, not evil[^.]{0,80}|shall be used for good, not evil
cecill-2.1 ; cecill ; governed by the cecill license
openssl ; openssl ; this product includes software developed by the openssl project[^.]{0,120}license|openssl license
busl-1.1 ; business source license ; business source license 1\.1
sspl-1.0 ; server side public license ; server side public license,? (?:version |v\.? ?)?1
elastic-2.0 ; elastic license ; elastic license,? (?:version |v\.? ?)?2(?:\.0)?
polyform-nc ; polyform ; polyform noncommercial license
rail ; responsible ai ; (?:creativeml |bigscience )?(?:open )?responsible ai license
llama-community ; llama ; llama ?[0-9.]* community license(?: agreement)?
"""

#: Identifiers as files state them, and names with versions.
VERSIONED = r"""
apache-2.0 ; apache-2.0 ; spdx-license-identifier: ?apache-2\.0
mit ; mit ; spdx-license-identifier: ?mit\b
isc ; isc ; spdx-license-identifier: ?isc\b
bsd-2-clause ; bsd-2-clause ; spdx-license-identifier: ?bsd-2-clause
bsd-3-clause ; bsd-3-clause ; spdx-license-identifier: ?bsd-3-clause
gpl-2.0-or-later ; gpl-2.0 ; spdx-license-identifier: ?gpl-2\.0(?:-or-later|\+)
gpl-3.0-or-later ; gpl-3.0 ; spdx-license-identifier: ?gpl-3\.0(?:-or-later|\+)
gpl-2.0 ; gpl-2.0 ; spdx-license-identifier: ?gpl-2\.0(?:-only)?
gpl-3.0 ; gpl-3.0 ; spdx-license-identifier: ?gpl-3\.0(?:-only)?
lgpl-2.1-or-later ; lgpl-2.1 ; spdx-license-identifier: ?lgpl-2\.1(?:-or-later|\+)
lgpl-3.0-or-later ; lgpl-3.0 ; spdx-license-identifier: ?lgpl-3\.0(?:-or-later|\+)
lgpl-2.1 ; lgpl-2.1 ; spdx-license-identifier: ?lgpl-2\.1(?:-only)?
lgpl-3.0 ; lgpl-3.0 ; spdx-license-identifier: ?lgpl-3\.0(?:-only)?
agpl-3.0 ; agpl-3.0 ; spdx-license-identifier: ?agpl-3\.0(?:-only|-or-later)?
mpl-2.0 ; mpl-2.0 ; spdx-license-identifier: ?mpl-2\.0
epl-2.0 ; epl-2.0 ; spdx-license-identifier: ?epl-2\.0
unlicense ; unlicense ; spdx-license-identifier: ?unlicense
cc0-1.0 ; cc0-1.0 ; spdx-license-identifier: ?cc0-1\.0
cc-by-4.0 ; cc-by-4.0 ; spdx-license-identifier: ?cc-by-4\.0
bsl-1.0 ; bsl-1.0 ; spdx-license-identifier: ?bsl-1\.0
zlib ; zlib ; spdx-license-identifier: ?zlib
apache-2.0 ; apache ; \bapache(?: software)? license,? (?:version |v\.? ?)?2(?:\.0)?\b
apache-2.0 ; apache-2.0 ; \bapache-2\.0 license
apache-1.1 ; apache ; \bapache(?: software)? license,? (?:version |v\.? ?)?1\.1\b
apache-1.0 ; apache ; \bapache(?: software)? license,? (?:version |v\.? ?)?1\.0\b
gpl-3.0 ; general public license ; (?:\bgnu )?general public license,? (?:\(gpl\),? )?(?:version |v\.? ?)?3(?:\.0)?\b
gpl-2.0 ; general public license ; (?:\bgnu )?general public license,? (?:\(gpl\),? )?(?:version |v\.? ?)?2(?:\.0)?\b
gpl-1.0 ; general public license ; (?:\bgnu )?general public license,? (?:version |v\.? ?)?1(?:\.0)?\b
gpl-3.0 ; gpl ; \bgplv3\b.{0,30}license|license.{0,30}\bgplv3\b
gpl-2.0 ; gpl ; \bgplv2\b.{0,30}license|license.{0,30}\bgplv2\b
lgpl-3.0 ; lesser general public license ; (?:\bgnu )?lesser general public license,? (?:\(lgpl\),? )?(?:version |v\.? ?)?3(?:\.0)?\b
lgpl-2.1 ; lesser general public license ; (?:\bgnu )?lesser general public license,? (?:\(lgpl\),? )?(?:version |v\.? ?)?2\.1\b
lgpl-2.0 ; library general public license ; (?:\bgnu )?library general public license,? (?:version |v\.? ?)?2(?:\.0)?\b
agpl-3.0 ; affero general public license ; (?:\bgnu )?affero general public license,? (?:\(agpl\),? )?(?:version |v\.? ?)?3(?:\.0)?\b
agpl-1.0 ; affero general public license ; \baffero general public license,? (?:version |v\.? ?)?1(?:\.0)?\b
gfdl-1.3 ; free documentation license ; (?:\bgnu )?free documentation license,? (?:version |v\.? ?)?1\.3\b
gfdl-1.2 ; free documentation license ; (?:\bgnu )?free documentation license,? (?:version |v\.? ?)?1\.2\b
gfdl-1.1 ; free documentation license ; (?:\bgnu )?free documentation license,? (?:version |v\.? ?)?1\.1\b
mpl-2.0 ; mozilla public license ; \bmozilla public license,? (?:version |v\.? ?)?2(?:\.0)?\b
mpl-1.1 ; mozilla public license ; \bmozilla public license,? (?:version |v\.? ?)?1\.1\b
mpl-1.0 ; mozilla public license ; \bmozilla public license,? (?:version |v\.? ?)?1\.0\b
epl-2.0 ; eclipse public license ; \beclipse public license,?(?: -)? (?:version |v\.? ?)?2(?:\.0)?\b
epl-1.0 ; eclipse public license ; \beclipse public license,?(?: -)? (?:version |v\.? ?)?1(?:\.0)?\b
eupl-1.2 ; european union public ; \beuropean union public license,? (?:version |v\.? ?)?1\.2\b
eupl-1.1 ; european union public ; \beuropean union public license,? (?:version |v\.? ?)?1\.1\b
cddl-1.1 ; common development ; \bcommon development and distribution license,? (?:\(cddl\),? )?(?:version |v\.? ?)?1\.1\b
cddl-1.0 ; common development ; \bcommon development and distribution license,? (?:\(cddl\),? )?(?:version |v\.? ?)?1(?:\.0)?\b
cpl-1.0 ; common public license ; \bcommon public license,? (?:version |v\.? ?)?1(?:\.0)?\b
artistic-2.0 ; artistic license ; \bartistic license,? (?:version |v\.? ?)?2(?:\.0)?\b
artistic-1.0 ; artistic license ; \bartistic license,? (?:version |v\.? ?)?1(?:\.0)?\b
bsl-1.0 ; boost software license ; \bboost software license,? (?:-? ?version |v\.? ?)?1(?:\.0)?\b
osl-3.0 ; open software license ; \bopen software license,? (?:version |v\.? ?)?3(?:\.0)?\b
osl-2.1 ; open software license ; \bopen software license,? (?:version |v\.? ?)?2\.1\b
afl-3.0 ; academic free license ; \bacademic free license,? (?:version |v\.? ?)?3(?:\.0)?\b
afl-2.1 ; academic free license ; \bacademic free license,? (?:version |v\.? ?)?2\.1\b
ofl-1.1 ; open font license ; \b(?:sil )?open font license,? (?:version |v\.? ?)?1\.1\b
ofl-1.0 ; open font license ; \b(?:sil )?open font license,? (?:version |v\.? ?)?1\.0\b
zpl-2.1 ; zope public license ; \bzope public license,? (?:\(zpl\),? )?(?:version |v\.? ?)?2\.1\b
zpl-2.0 ; zope public license ; \bzope public license,? (?:\(zpl\),? )?(?:version |v\.? ?)?2\.0\b
php-3.01 ; php license ; \bphp license,? (?:version |v\.? ?)?3\.01\b
php-3.0 ; php license ; \bphp license,? (?:version |v\.? ?)?3\.0\b
lppl-1.3c ; latex project public ; \blatex project public license,? (?:version |v\.? ?)?1\.3c?\b
lppl-1.2 ; latex project public ; \blatex project public license,? (?:version |v\.? ?)?1\.2\b
w3c ; w3c ; \bw3c software (?:and document )?(?:notice and )?license
upl-1.0 ; universal permissive ; \buniversal permissive license,? (?:\(upl\),? )?(?:version |v\.? ?)?1(?:\.0)?\b
blueoak-1.0.0 ; blue oak ; \bblue oak model license(?:,? (?:version )?1\.0\.0)?
mulan-psl-2.0 ; mulan ; \bmulan (?:permissive software|psl) license,? (?:version |v\.? ?)?2\b
cc0-1.0 ; cc0 ; \bcc0[ -]1\.0\b
cc0-1.0 ; cc0 ; \bcc0 1\.0 universal\b
cc-by-nc-sa-4.0 ; cc ; \bcc[ -]by-nc-sa[ -]4\.0
cc-by-nc-sa-3.0 ; cc ; \bcc[ -]by-nc-sa[ -]3\.0
cc-by-nc-nd-4.0 ; cc ; \bcc[ -]by-nc-nd[ -]4\.0
cc-by-nc-nd-3.0 ; cc ; \bcc[ -]by-nc-nd[ -]3\.0
cc-by-nc-4.0 ; cc ; \bcc[ -]by-nc[ -]4\.0
cc-by-nc-3.0 ; cc ; \bcc[ -]by-nc[ -]3\.0
cc-by-nc-2.0 ; cc ; \bcc[ -]by-nc[ -]2\.0
cc-by-nd-4.0 ; cc ; \bcc[ -]by-nd[ -]4\.0
cc-by-nd-3.0 ; cc ; \bcc[ -]by-nd[ -]3\.0
cc-by-sa-4.0 ; cc ; \bcc[ -]by-sa[ -]4\.0
cc-by-sa-3.0 ; cc ; \bcc[ -]by-sa[ -]3\.0
cc-by-sa-2.5 ; cc ; \bcc[ -]by-sa[ -]2\.5
cc-by-sa-2.0 ; cc ; \bcc[ -]by-sa[ -]2\.0
cc-by-4.0 ; cc ; \bcc[ -]by[ -]4\.0
cc-by-3.0 ; cc ; \bcc[ -]by[ -]3\.0
cc-by-2.5 ; cc ; \bcc[ -]by[ -]2\.5
cc-by-2.0 ; cc ; \bcc[ -]by[ -]2\.0
cc-by-4.0 ; creative commons ; \bcreative commons attribution 4\.0(?: international)?(?: license)?
cc-by-3.0 ; creative commons ; \bcreative commons attribution 3\.0(?: unported)?(?: license)?
cc-by-sa-4.0 ; creative commons ; \bcreative commons attribution[ -]share-?alike 4\.0(?: international)?(?: license)?
cc-by-sa-3.0 ; creative commons ; \bcreative commons attribution[ -]share-?alike 3\.0(?: unported)?(?: license)?
cc-by-nc-4.0 ; creative commons ; \bcreative commons attribution[ -]non-?commercial 4\.0(?: international)?(?: license)?
cc-by-nc-sa-4.0 ; creative commons ; \bcreative commons attribution[ -]non-?commercial[ -]share-?alike 4\.0(?: international)?(?: license)?
cc-by-nc-nd-4.0 ; creative commons ; \bcreative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s 4\.0(?: international)?(?: license)?
"""

#: Names without a version.
NAMED = r"""
apache ; apache ; \b(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license\b
mit ; mit ; \b(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit(?:/x11| expat)? license\b
bsd ; bsd ; \b(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?:-style)? license\b
gpl ; general public license ; \b(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license\b
lgpl ; lesser general public license ; \b(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license\b
apache ; apache ; \bapache(?: software)? license\b
mit ; mit ; \bmit(?:/x11| expat)? license\b
mit ; expat ; \bexpat license\b
x11 ; x11 ; \bx11 license\b
isc ; isc ; \bisc license\b
lgpl ; lesser general public license ; \b(?:gnu )?lesser general public license\b
lgpl ; library general public license ; \b(?:gnu )?library general public license\b
agpl ; affero general public license ; \b(?:gnu )?affero general public license\b
gpl ; general public license ; \bgnu general public license\b
gfdl ; free documentation license ; \b(?:gnu )?free documentation license\b
gpl ; gpl ; \b(?:gnu )?gpl license\b|\blicensed under (?:the )?(?:gnu )?gpl\b
lgpl ; lgpl ; \blgpl license\b|\blicensed under (?:the )?lgpl\b
agpl ; agpl ; \bagpl license\b|\blicensed under (?:the )?agpl\b
bsd-2-clause ; bsd ; \b(?:simplified|2-clause|two-clause|freebsd) bsd license\b
bsd-3-clause ; bsd ; \b(?:new|revised|modified|3-clause|three-clause) bsd license\b
bsd-4-clause ; bsd ; \b(?:original|old|4-clause|four-clause) bsd license\b
bsd-2-clause ; bsd ; \bbsd[ -]2-clause(?: .simplified.)? license\b
bsd-3-clause ; bsd ; \bbsd[ -]3-clause(?: .(?:new|revised).)*(?: or .revised.)? license\b
bsd ; bsd ; \bbsd(?:-style)? license\b
mpl ; mozilla public license ; \bmozilla public license\b
epl ; eclipse public license ; \beclipse public license\b
eupl ; european union public ; \beuropean union public license\b
cddl ; common development ; \bcommon development and distribution license\b
cpl ; common public license ; \bcommon public license\b
ipl ; ibm public license ; \bibm public license\b
spl ; sun public license ; \bsun public license\b
npl ; netscape public license ; \bnetscape public license\b
qpl ; q public license ; \bq public license\b
artistic ; artistic license ; \bartistic license\b
bsl-1.0 ; boost software license ; \bboost software license\b
osl ; open software license ; \bopen software license\b
afl ; academic free license ; \bacademic free license\b
ofl ; open font license ; \b(?:sil )?open font license\b
odbl ; open database license ; \bopen database license\b
odc-by ; open data commons ; \bopen data commons attribution license\b
pddl ; public domain dedication ; \bpublic domain dedication and license\b
zpl ; zope public license ; \bzope public license\b
php ; php license ; \bphp license\b
lppl ; latex project public ; \blatex project public license\b
ms-pl ; microsoft public license ; \bmicrosoft public license\b
ms-rl ; microsoft reciprocal license ; \bmicrosoft reciprocal license\b
zlib ; zlib ; \bzlib(?:/libpng)? license\b
libpng ; libpng ; \blibpng license\b
unlicense ; unlicense ; \bthe unlicense\b
wtfpl ; wtfpl ; \bwtfpl license\b|\blicensed under (?:the )?wtfpl\b
postgresql ; postgresql license ; \bpostgresql license\b
psf ; python software foundation ; \bpython software foundation license\b
ruby ; ruby license ; \bruby license\b
ncsa ; ncsa ; \b(?:university of illinois/)?ncsa(?: open source)? license\b
vim ; vim license ; \bvim license\b
ijg ; independent jpeg group ; \bindependent jpeg group license\b
curl ; curl license ; \bcurl license\b
eiffel ; eiffel forum license ; \beiffel forum license\b
sleepycat ; sleepycat license ; \bsleepycat license\b
intel ; intel open source license ; \bintel open source license\b
nasa ; nasa open source ; \bnasa open source agreement\b[^.]{0,80}license|\bnasa open source license\b
rpl ; reciprocal public license ; \breciprocal public license\b
cecill ; cecill ; \bcecill(?:-[bc])? license\b
mulan ; mulan ; \bmulan permissive software license\b
busl ; business source license ; \bbusiness source license\b
sspl ; server side public license ; \bserver side public license\b
cc-by-nc-nd ; creative commons ; \bcreative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s(?: license)?\b
cc-by-nc-sa ; creative commons ; \bcreative commons attribution[ -]non-?commercial[ -]share-?alike(?: license)?\b
cc-by-nc ; creative commons ; \bcreative commons attribution[ -]non-?commercial(?: license)?\b
cc-by-nd ; creative commons ; \bcreative commons attribution[ -]no-?deriv(?:ative)?s(?: license)?\b
cc-by-sa ; creative commons ; \bcreative commons attribution[ -]share-?alike(?: license)?\b
cc-by ; creative commons ; \bcreative commons attribution(?: license)?\b
cc-by-nc-nd ; cc ; \bcc[ -]by-nc-nd\b
cc-by-nc-sa ; cc ; \bcc[ -]by-nc-sa\b
cc-by-nc ; cc ; \bcc[ -]by-nc\b
cc-by-nd ; cc ; \bcc[ -]by-nd\b
cc-by-sa ; cc ; \bcc[ -]by-sa\b
cc-by ; cc ; \bcc[ -]by\b
cc0 ; cc0 ; \bcc0\b
cc0 ; creative commons zero ; \bcreative commons zero\b
creative-commons ; creative commons ; \bcreative commons license\b
"""

#: Notices that name no license.
NOTICES = r"""
public-domain ; public domain ; \b(?:dedicated to|released into|placed in|put in|belongs? to|in) the public domain\b
copyright-notice ; copyright ; \bcopyright (?:\(c\) |© ?)?(?:19|20)[0-9]{2}\b
copyright-notice ; © ; © ?(?:19|20)[0-9]{2}\b
no-permission ; permission ; \bmay not be (?:reproduced|copied|distributed|republished)[^.]{0,80} without (?:the )?(?:express |prior |explicit )*(?:written )?permission
no-permission ; copyright ; \bmay not be (?:reproduced|copied|distributed|republished)[^.]{0,80} without (?:the )?(?:written )?consent of the copyright (?:owner|holder)
no-permission ; permission ; \bno part of this (?:publication|book|work|site|document) may be [^.]{0,160} without [^.]{0,60}permission
no-redistribution ; redistribut ; \bredistribution[^.]{0,40} (?:is )?(?:strictly )?(?:prohibited|not permitted|forbidden)
no-redistribution ; redistribut ; \bnot (?:be )?(?:for redistribution|redistributed)\b
proprietary ; proprietary ; \bconfidential and proprietary\b|\bproprietary and confidential\b
proprietary ; proprietary ; \bproprietary (?:software|information|material) of\b
non-commercial ; license ; \blicensed? for (?:personal|research|academic|non-?commercial) use only\b
evaluation ; license ; \b(?:trial|evaluation) license\b
eula ; license ; \bend[ -]user license agreement\b
commercial ; license ; \bcommercial license\b
royalty-free ; license ; \broyalty-free license\b
"""

#: What a blank of an expression stands for.
BLANK = r"[ \t\r\n*#]+"
WEIGHTS = ((GRANTS, 1.0), (VERSIONED, 0.9), (NAMED, 0.7), (NOTICES, 0.5))


def _expression(text: str) -> str:
    """The expression of a line: blanks outside brackets become BLANK, an optional blank may be missing, and both spellings fit."""
    out, inside = [], False
    for k, c in enumerate(text):
        inside = c == "[" or inside and c != "]"
        if c == " " and not inside:
            c = f"(?:{BLANK})" if text[k + 1 : k + 2] == "?" else BLANK
        out.append(c)
    # Addresses and identifiers have one spelling.
    return re.sub("(?<![/n-])license", "licen[sc]e", "".join(out)).replace("[ -]", r"[ \t\r\n-]")


def _read() -> list[Rule]:
    out = []
    for lines, weight in WEIGHTS:
        for line in lines.strip().splitlines():
            label, keyword, text = line.split(" ; ")
            # Keywords are looked up as they stand, so of several words the longest is: a text may break its line between them.
            word = max(keyword.split(), key=len)
            out.append(Rule(label, "licen" if word.startswith("licen") else word, _expression(text), len(out), weight))
    return out


RULES = _read()
#: What every text has where any rule can match; the first gate.
GATE = r"(?i)licen[sc]|permission|copyright|©|warrant|redistribut|misrepresented|domain|proprietary|spdx|commons|cc0|cc[ \t\r\n-]by|evil"
