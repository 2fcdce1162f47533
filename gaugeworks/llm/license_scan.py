"""License scans: ordered signature rules over normalised words (operator 2). DataFrame functions only.

A text becomes its words, A-Z in lower case, one space apart. Each rule has a keyword, and most a second
piece, without which it cannot match: both are parts of every text that its pattern matches. Only texts
with some keyword are looked at further, and only rules of which both are present are matched. Detections that overlap are resolved by priority, then by containment: one goes if another of
higher priority overlaps it, or if it lies inside a longer one (or an earlier rule's equal one) of the
same priority. Four base phrases are found besides, and their labels always stay.

Scale: one projection, with no shuffle and no Python; the rules are a constant of a few hundred rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What separates words, before and after A-Z are lowered.
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: (label, keyword, names as a pattern, versions as a pattern or nothing); words as normalised.
FAMILIES = [
    ("gpl", "gnu general", "gnu general public licen[cs]e", "[123](?: 0)?"),
    ("gpl", "gpl", "gnu gpl|gpl", "[123](?: 0)?"),
    ("lgpl", "lesser general", "gnu lesser general public licen[cs]e|lesser general public licen[cs]e", "[23](?: [01])?"),
    ("lgpl", "library general", "gnu library general public licen[cs]e", "2(?: 0)?"),
    ("lgpl", "lgpl", "lgpl|gnu lgpl", "[23](?: [01])?"),
    ("agpl", "affero", "gnu affero general public licen[cs]e|affero general public licen[cs]e", "[13](?: 0)?"),
    ("agpl", "agpl", "agpl|gnu agpl", "[13](?: 0)?"),
    ("gfdl", "free documentation", "gnu free documentation licen[cs]e", "1(?: [123])?"),
    ("apache", "apache", "apache(?: software)? licen[cs]e|apache", "[12](?: [01])?"),
    ("mit", "mit", "mit(?: x11)? licen[cs]e|mit", ""),
    ("mit", "expat", "expat licen[cs]e", ""),
    ("x11", "x11", "x11 licen[cs]e", ""),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e|bsd", "(?:[0234]|two|three|four) clause"),
    ("isc", "isc", "isc licen[cs]e|isc", ""),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "[12](?: [01])?"),
    ("mpl", "mpl", "mpl", "[12](?: [01])?"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "[12](?: 0)?"),
    ("epl", "epl", "epl", "[12](?: 0)?"),
    ("edl", "eclipse distribution", "eclipse distribution licen[cs]e", "1(?: 0)?"),
    ("cddl", "common development", "common development and distribution licen[cs]e", "1(?: [01])?"),
    ("cddl", "cddl", "cddl", "1(?: [01])?"),
    ("cpl", "common public", "common public licen[cs]e", "1(?: 0)?"),
    ("eupl", "european union", "european union public licen[cs]e", "1(?: [012])?"),
    ("eupl", "eupl", "eupl", "1(?: [012])?"),
    ("artistic", "artistic", "artistic licen[cs]e", "[12](?: 0)?"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ""),
    ("libpng", "libpng", "libpng licen[cs]e", "2?(?: 0)?"),
    ("boost", "boost", "boost software licen[cs]e", "1(?: 0)?"),
    ("boost", "bsl", "bsl", "1(?: 0)?"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "[12]?"),
    ("wtfpl", "do what the fuck", "do what the fuck you want to public licen[cs]e", "2?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ""),
    ("python", "python", "python(?: software foundation)? licen[cs]e", "[23](?: [0-9])?"),
    ("python", "psf", "psf licen[cs]e", "[23](?: [0-9])?"),
    ("php", "php", "php licen[cs]e", "3(?: [01]{1,2})?"),
    ("ruby", "ruby", "ruby licen[cs]e", ""),
    ("openssl", "openssl", "openssl licen[cs]e", ""),
    ("ofl", "open font", "sil open font licen[cs]e|open font licen[cs]e", "1(?: [01])?"),
    ("ofl", "ofl", "ofl", "1(?: [01])?"),
    ("odbl", "open database", "open database licen[cs]e", "1(?: 0)?"),
    ("odbl", "odbl", "odbl", "1(?: 0)?"),
    ("pddl", "public domain dedication", "public domain dedication(?: and licen[cs]e)?", "1(?: 0)?"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", ""),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "1(?: 0)?"),
    ("ecl", "educational community", "educational community licen[cs]e", "[12](?: 0)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    ("vim", "vim", "vim licen[cs]e", ""),
    ("beerware", "beerware", "beerware licen[cs]e|beerware", ""),
    ("json", "json", "json licen[cs]e", ""),
    ("sspl", "server side public", "server side public licen[cs]e", "1?"),
    ("sspl", "sspl", "sspl", "1?"),
    ("busl", "business source", "business source licen[cs]e", "1(?: 1)?"),
    ("elastic", "elastic", "elastic licen[cs]e", "2?(?: 0)?"),
    ("cc0", "cc0", "cc0", "1(?: 0)?"),
    ("cc0", "creative commons zero", "creative commons zero", "1(?: 0)?"),
    ("cc-by", "creative commons attribution", "creative commons attribution", "[1234](?: [05])?(?: international| unported)?"),
    ("cc-by-sa", "cc by sa", "cc by sa", "[1234](?: [05])?"),
    ("cc-by-nc", "cc by nc", "cc by nc", "[1234](?: [05])?"),
    ("cc-by-nd", "cc by nd", "cc by nd", "[1234](?: [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", "[1234](?: [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", "[1234](?: [05])?"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", "[1234](?: [05])?(?: international| unported)?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", "[1234](?: [05])?(?: international| unported)?"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives", "[1234](?: [05])?(?: international| unported)?"),
    ("cc-by", "cc by", "cc by", "[1234](?: [05])?"),
]
#: One signature a line: label, priority, keyword, pattern over normalised words. Titles, headers, notices,
#: addresses, classifiers and badges as licenses and their users write them.
SIGNATURES = """
    gpl|4|gnu general|(?:this program is free software you can )?redistribute it and or modify it under the terms of the gnu general public licen[cs]e
    gpl|4|gnu general|you should have received a copy of the gnu general public licen[cs]e
    gpl|4|gnu general|may be used under the terms of the gnu general public licen[cs]e
    gpl|4|gnu general|covered by the gnu general public licen[cs]e
    gpl|4|gnu general|see the gnu general public licen[cs]e for more details
    gpl|3|gnu general|gnu general public licen[cs]e(?: as published by the free software foundation)? either version [123]
    gpl|3|gnu general|version [123] of the gnu general public licen[cs]e
    gpl|2|gnu general|gnu general public licen[cs]e
    gpl|2|general public license|(?:the )?general public license
    gpl|3|gplv|gplv[123](?: only| or later)?
    gpl|3|gnu gpl|(?:the )?gnu gpl(?: v[123]| version [123])?
    gpl|5|gnu org|gnu org licen[cs]es (?:old licen[cs]es )?gpl(?: [123] 0)?
    gpl|5|gpl|licen[cs]e gpl v?[123](?: 0)?
    gpl|5|osi|licen[cs]e osi approved gnu general public licen[cs]e
    gpl|5|badge|badge licen[cs]e gpl(?:v?[123]| v?[123](?: 0)?)?
    gpl|4|classpath|gpl(?: [123](?: 0)?)? with classpath exception
    lgpl|4|lesser general|(?:this library is free software you can )?redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
    lgpl|4|lesser general|you should have received a copy of the gnu lesser general public licen[cs]e
    lgpl|4|library general|you should have received a copy of the gnu library general public licen[cs]e
    lgpl|4|lesser general|see the gnu lesser general public licen[cs]e for more details
    lgpl|3|lesser general|version [23](?: 1)? of the gnu lesser general public licen[cs]e
    lgpl|2|lesser general|gnu lesser general public licen[cs]e
    lgpl|2|library general|gnu library general public licen[cs]e
    lgpl|3|lgplv|lgplv[23](?: 1)?(?: only| or later)?
    lgpl|5|gnu org|gnu org licen[cs]es (?:old licen[cs]es )?lgpl(?: [23] [01])?
    lgpl|5|osi|licen[cs]e osi approved gnu lesser general public licen[cs]e
    lgpl|5|badge|badge licen[cs]e lgpl(?:v?[23]| v?[23](?: [01])?)?
    agpl|4|affero|under the terms of the gnu affero general public licen[cs]e
    agpl|4|affero|you should have received a copy of the gnu affero general public licen[cs]e
    agpl|3|affero|version [13] of the gnu affero general public licen[cs]e
    agpl|2|affero|gnu affero general public licen[cs]e
    agpl|3|agplv|agplv3(?: only| or later)?
    agpl|5|gnu org|gnu org licen[cs]es agpl(?: 3 0)?
    agpl|5|osi|licen[cs]e osi approved gnu affero general public licen[cs]e
    agpl|5|badge|badge licen[cs]e agpl(?:v?3| v?3(?: 0)?)?
    gfdl|4|free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
    gfdl|2|free documentation|gnu free documentation licen[cs]e
    gfdl|4|invariant sections|with no invariant sections no front cover texts and no back cover texts
    gfdl|5|gnu org|gnu org licen[cs]es fdl(?: 1 [123])?
    apache|4|apache|licen[cs]ed under the apache licen[cs]e version 2 0
    apache|4|apache|licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements
    apache|4|apache|the asf licen[cs]es this file to you under the apache licen[cs]e
    apache|5|apache org|apache org licen[cs]es licen[cs]e [12] [01]
    apache|5|osi|licen[cs]e osi approved apache software licen[cs]e
    apache|5|badge|badge licen[cs]e apache(?: 2(?: 0)?)?
    apache|3|apache|apache(?: software)? licen[cs]e v?2(?: 0)?
    apache|3|asl|asl 2 0
    apache|2|apache software|apache software licen[cs]e
    apache|4|apache|this product includes software developed by the apache software foundation
    apache|4|as is basis|distributed on an as is basis without warranties or conditions of any kind either express or implied
    apache|2|you may not use this file|you may not use this file except in compliance with the licen[cs]e
    mit|4|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
    mit|4|substantial portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
    mit|3|as is|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
    mit|4|mit|(?:licen[cs]ed|released|available) under the mit licen[cs]e
    mit|4|mit|see the mit licen[cs]e for (?:more )?details
    mit|5|opensource org|opensource org licen[cs]es mit(?: licen[cs]e)?(?: php)?
    mit|5|osi|licen[cs]e osi approved mit licen[cs]e
    mit|5|badge|badge licen[cs]e mit
    mit|5|choosealicense|choosealicense com licen[cs]es mit
    mit|3|mit|the mit licen[cs]e mit
    mit|2|expat|mit expat licen[cs]e
    mit|4|mit 0|mit 0
    mit|4|mit no attribution|mit no attribution(?: licen[cs]e)?
    x11|4|x consortium|except as contained in this notice the name of the x consortium shall not be used in advertising
    x11|2|x11|(?:mit )?x11(?: style)? licen[cs]e
    bsd|4|redistribution and use|redistribution and use in source and binary forms with or without modification(?: are permitted provided that the following conditions are met)?
    bsd|4|redistributions of source|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    bsd|4|redistributions in binary|redistributions in binary form must reproduce the above copyright notice this list of conditions
    bsd|4|copyright holders and contributors|this software is provided by the copyright holders and contributors as is
    bsd|4|regents|this software is provided by the regents and contributors as is
    bsd|4|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
    bsd|4|bsd style|use of this source code is governed by a bsd style licen[cs]e
    bsd|5|opensource org|opensource org licen[cs]es bsd(?: [23] clause| licen[cs]e)
    bsd|5|osi|licen[cs]e osi approved bsd licen[cs]e
    bsd|5|badge|badge licen[cs]e bsd(?: [0234] clause)?
    bsd|3|bsd|[0234] clause bsd(?: licen[cs]e)?
    bsd|3|bsd|(?:new|modified|simplified|revised|original|free) bsd(?: licen[cs]e)?
    bsd|2|bsd|bsd(?: style)? licen[cs]ed?
    0bsd|3|0bsd|0bsd(?: licen[cs]e)?
    0bsd|3|zero clause|zero clause bsd(?: licen[cs]e)?
    isc|4|permission to use copy modify|permission to use copy modify and (?:or )?distribute this software for any purpose(?: with or without fee is hereby granted)?
    isc|4|the author disclaims|the software is provided as is and the author disclaims all warranties with regard to this software
    isc|5|opensource org|opensource org licen[cs]es isc(?: licen[cs]e)?
    isc|5|osi|licen[cs]e osi approved isc licen[cs]e
    isc|5|badge|badge licen[cs]e isc
    isc|2|isc|isc licen[cs]ed?
    isc|2|internet systems|internet systems consortium licen[cs]e
    mpl|4|mozilla|this source code form is subject to the terms of the mozilla public licen[cs]e
    mpl|4|mozilla|the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]
    mpl|4|incompatible with secondary|incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e
    mpl|5|mozilla org|mozilla org mpl(?: 2 0| mpl 1 [01])?
    mpl|5|osi|licen[cs]e osi approved mozilla public licen[cs]e
    mpl|5|badge|badge licen[cs]e mpl(?: 2(?: 0)?)?
    mpl|2|mozilla|mozilla public licen[cs]e
    epl|4|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
    epl|5|eclipse org|eclipse org (?:legal epl|org documents epl)(?: v10| 2 0| v20)?
    epl|5|osi|licen[cs]e osi approved eclipse public licen[cs]e
    epl|5|badge|badge licen[cs]e epl(?: [12](?: 0)?)?
    epl|2|eclipse|eclipse public licen[cs]e
    edl|5|eclipse org|eclipse org org documents edl
    edl|2|eclipse distribution|eclipse distribution licen[cs]e
    cddl|4|common development|the contents of this file are subject to the terms of the common development and distribution licen[cs]e
    cddl|4|cddl|include this cddl header notice in each file
    cddl|2|common development|common development and distribution licen[cs]e
    cddl|5|opensource org|opensource org licen[cs]es cddl(?: 1 0| 1)?
    cpl|4|common public|made available under the terms of the common public licen[cs]e
    cpl|2|common public|common public licen[cs]e
    eupl|4|eupl|licen[cs]ed under the eupl
    eupl|5|joinup|joinup ec europa eu (?:software page|collection) eupl
    eupl|2|european union|european union public licen[cs]e
    artistic|4|artistic|under the artistic licen[cs]e
    artistic|2|artistic|(?:the )?(?:clarified )?artistic licen[cs]e
    artistic|5|opensource org|opensource org licen[cs]es artistic licen[cs]e(?: [12] 0)?
    perl|4|same terms as perl|under the same terms as perl(?: itself| 5)?
    zlib|4|altered source versions|altered source versions must be plainly marked as such(?: and must not be misrepresented as being the original software)?
    zlib|4|origin of this software|the origin of this software must not be misrepresented you must not claim that you wrote the original software
    zlib|4|in no event will the authors|in no event will the authors be held liable for any damages arising from the use of this software
    zlib|2|zlib|zlib(?: libpng)? licen[cs]e
    libpng|4|libpng|this code is released under the libpng licen[cs]e
    libpng|2|libpng|libpng licen[cs]e
    boost|4|boost|distributed under the boost software licen[cs]e version 1 0
    boost|5|boost org|boost org licen[cs]e 1 0
    boost|2|boost|boost software licen[cs]e
    boost|5|badge|badge licen[cs]e bsl 1 0
    unlicense|4|free and unencumbered|(?:this is )?free and unencumbered software released into the public domain
    unlicense|4|anyone is free|anyone is free to copy modify publish use compile sell or distribute this software
    unlicense|5|unlicense org|unlicense org
    unlicense|5|badge|badge licen[cs]e unlicense
    unlicense|2|unlicense|the unlicense
    wtfpl|4|do what the fuck|you just do what the fuck you want to
    wtfpl|5|wtfpl net|wtfpl net
    wtfpl|2|wtfpl|wtfpl(?: licen[cs]e)?
    postgresql|4|postgresql|released under the postgresql licen[cs]e
    postgresql|2|postgresql|postgresql licen[cs]e
    python|4|python software foundation|this licen[cs]e agreement is between the python software foundation psf and the individual or organization
    python|5|osi|licen[cs]e osi approved python software foundation licen[cs]e
    python|2|python|python(?: software foundation)? licen[cs]e
    python|3|psf|psf licen[cs]e agreement for python
    php|4|php|this source file is subject to version [23](?: [01]{1,2})? of the php licen[cs]e
    php|5|php net|php net licen[cs]e(?: [23] [01]{1,2} txt)?
    ruby|4|ruby|(?:distributed|released) under the (?:same terms as ruby|ruby licen[cs]e)
    openssl|4|openssl|this product includes software developed by the openssl project for use in the openssl toolkit
    openssl|2|openssl|openssl licen[cs]e
    ssleay|4|eric young|this product includes cryptographic software written by eric young
    ofl|4|open font|this font software is licen[cs]ed under the sil open font licen[cs]e
    ofl|4|reserved font name|with reserved font name
    ofl|5|scripts sil org|scripts sil org ofl
    ofl|2|open font|(?:sil )?open font licen[cs]e
    odbl|4|open database|made available under the open database licen[cs]e
    odbl|5|opendatacommons|opendatacommons org licen[cs]es odbl(?: 1 0)?
    pddl|5|opendatacommons|opendatacommons org licen[cs]es pddl(?: 1 0)?
    odc-by|5|opendatacommons|opendatacommons org licen[cs]es by(?: 1 0)?
    odc-by|2|open data commons|open data commons attribution licen[cs]e
    odbl|2|open data commons|open data commons open database licen[cs]e
    ms-pl|2|microsoft public|microsoft public licen[cs]e
    ms-pl|3|ms pl|ms pl(?: licen[cs]e)?
    ms-rl|3|ms rl|ms rl(?: licen[cs]e)?
    ms-rl|2|microsoft reciprocal|microsoft reciprocal licen[cs]e
    upl|4|universal permissive|licen[cs]ed under the universal permissive licen[cs]e
    upl|5|oss oracle com|oss oracle com licen[cs]es upl
    ecl|4|educational community|licen[cs]ed under the educational community licen[cs]e
    ncsa|4|illinois|university of illinois ncsa open source licen[cs]e
    ncsa|2|ncsa|(?:illinois )?ncsa(?: open source)? licen[cs]e
    vim|2|vim|vim licen[cs]e
    beerware|4|buy me a beer|you can buy me a beer in return
    beerware|2|beerware|beerware licen[cs]e
    beerware|2|beer ware|(?:the )?beer ware licen[cs]e
    json|4|good not evil|the software shall be used for good not evil
    json|2|json|json licen[cs]e
    sspl|4|server side public|under the terms of the server side public licen[cs]e
    sspl|5|mongodb com|mongodb com licen[cs]ing server side public licen[cs]e
    sspl|2|server side public|server side public licen[cs]e
    busl|4|business source|use of this software is governed by the business source licen[cs]e
    busl|4|additional use grant|additional use grant
    busl|5|mariadb com|mariadb com bsl11
    busl|2|business source|business source licen[cs]e
    elastic|4|elastic|licen[cs]ed under the elastic licen[cs]e
    elastic|5|elastic co|elastic co licen[cs]ing elastic licen[cs]e
    elastic|2|elastic|elastic licen[cs]e
    commons-clause|4|commons clause|the software is provided to you by the licensor under the licen[cs]e as defined below subject to the following condition commons clause
    commons-clause|2|commons clause|commons clause(?: licen[cs]e condition)?
    cc0|4|waived all copyright|has waived all copyright and related or neighbo(?:u)?ring rights
    cc0|5|creativecommons org|creativecommons org publicdomain zero(?: 1 0)?
    cc0|4|creative commons|creative commons cc0
    cc0|4|no rights reserved|no rights reserved
    cc0|5|badge|badge licen[cs]e cc0(?: 1 0)?
    cc-pdm|5|creativecommons org|creativecommons org publicdomain mark(?: 1 0)?
    cc-by|5|creativecommons org|creativecommons org licen[cs]es by(?: [1234] [05])?(?! (?:nc|nd|sa) )
    cc-by-sa|5|creativecommons org|creativecommons org licen[cs]es by sa(?: [1234] [05])?
    cc-by-nd|5|creativecommons org|creativecommons org licen[cs]es by nd(?! nc )(?: [1234] [05])?
    cc-by-nc|5|creativecommons org|creativecommons org licen[cs]es by nc(?! (?:nd|sa) )(?: [1234] [05])?
    cc-by-nc-sa|5|creativecommons org|creativecommons org licen[cs]es by nc sa(?: [1234] [05])?
    cc-by-nc-nd|5|creativecommons org|creativecommons org licen[cs]es by nc nd(?: [1234] [05])?
    cc-by|4|creative commons|this work is licen[cs]ed under a creative commons attribution(?: [1234] [05])?(?: international)? licen[cs]e
    cc-by-sa|4|creative commons|this work is licen[cs]ed under a creative commons attribution share ?alike
    cc-by-nc|4|creative commons|this work is licen[cs]ed under a creative commons attribution non ?commercial(?! share| no ?deriv)
    cc-by-nc-sa|4|creative commons|creative commons attribution non ?commercial share ?alike
    cc-by-nc-nd|4|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s
    cc-by-nd|4|creative commons|creative commons attribution no ?deriv(?:ative)?s
    creative-commons|2|creative commons|creative commons licen[cs]e
    public-domain|3|public domain|(?:in|into|to) the public domain
    bsd|4|neither the name|neither the name of .{1,60} may be used to endorse or promote products
    boost|4|permission is hereby granted|permission is hereby granted free of charge to any person or organization obtaining a copy
    public-domain|4|public domain|(?:dedicated|released|placed|put) (?:in|into|to) the public domain
    public-domain|4|public domain|this (?:work|file|code|software|text) is (?:in|hereby in) the public domain
    public-domain|3|dedicated to the public|dedicated to the public domain by
    w3c|4|w3c|w3c software (?:and document )?(?:notice and )?licen[cs]e
    unicode|4|unicode|unicode(?: inc)? licen[cs]e agreement
    ijg|4|independent jpeg group|this software is based in part on the work of the independent jpeg group
    freetype|4|freetype|portions of this software are copyright (?:.{0,20} )?the freetype project
    freetype|2|freetype|freetype licen[cs]e
    curl|2|curl|curl licen[cs]e
    bzip2|2|bzip2|bzip2(?: and libbzip2)? licen[cs]e
    hpnd|4|permission to use copy modify|permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
    afl|2|academic free|academic free licen[cs]e(?: v?[123](?: [012])?)?
    osl|2|open software|open software licen[cs]e(?: v?[123](?: 0)?)?
    qpl|2|q public|q public licen[cs]e
    ipl|2|ibm public|ibm public licen[cs]e
    apsl|2|apple public|apple public source licen[cs]e
    rpl|2|reciprocal public|reciprocal public licen[cs]e
    cecill|2|cecill|(?:the )?cecill(?: [abc])?(?: v?[12](?: [01])?)?(?: licen[cs]e)?
    mulan|2|mulan|mulan (?:psl|permissive software licen[cs]e)(?: v?[12])?
    openrail|4|openrail|(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
    llama|4|llama|llama [234](?: [0-9])? community licen[cs]e(?: agreement)?
    gemma|4|gemma|gemma terms of use
    proprietary|4|all rights reserved|all rights reserved
    proprietary|4|confidential|(?:proprietary and confidential|confidential and proprietary)
    proprietary|4|unauthorized copying|unauthorized copying of this file via any medium is strictly prohibited
    proprietary|4|may be reproduced|no part of this (?:publication|book|document|work) may be reproduced
    proprietary|4|trade secrets|contains (?:confidential information and )?trade secrets of
    proprietary|3|end user|end user licen[cs]e agreement
    proprietary|3|commercial|(?:a )?commercial licen[cs]e is required
"""
#: The highest priority.
TOP = 5


@dataclass(frozen=True)
class Rule:
    """A signature: no text without both ``keyword`` and ``also`` can match ``pattern``."""

    keyword: str
    also: str
    pattern: str
    label: str
    priority: int


def required(pattern: str) -> str:
    """The longest piece that every match of a pattern has: what stands outside groups and is not optional."""
    while "(" in pattern:
        pattern = re.sub(r"\([^()]*\)[?]?", "\0", pattern)
    if "|" in pattern:
        return ""
    return max(re.split(r"\0|\[[^\]]*\][?]?|.\{[^}]*\}[?]?|.\?|\.", pattern), key=len)


def rules() -> list[Rule]:
    """All rules in order; a higher priority is surer of its label.

    Each family gives a rule for an identifier line, a grant, a name with its version, a "dual" mention,
    and its bare name followed by "license"; each signature is one.
    """
    out = []
    for label, keyword, names, versions in FAMILIES:
        version = f"(?:(?: version| v)? v?{versions})" if versions else ""
        named = f"(?:{names})"
        out.append((keyword, "identifier", f"spdx licen[cs]e identifier {named}{version and version + '?'}(?: only| or later)?", label, 5))
        out.append((keyword, "under", f"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{named}{version and version + '?'}", label, 4))
        if version:
            out.append((keyword, "", f"{named}{version}(?: only| or later| or any later version)?", label, 3))
        out.append((keyword, "dual licen", f"dual licen[cs]ed (?:.{{0,40}} )?{named}", label, 2))
        out.append((keyword, "licen", f"(?:{names})(?: public)? licen[cs]e|{named}(?= licen[cs]ed )", label, 1))
    for line in SIGNATURES.strip().split("\n"):
        label, priority, keyword, pattern = line.strip().split("|", 3)
        out.append((keyword, required(pattern), pattern, label, int(priority)))
    return [Rule(k, also, f"(?<= )(?:{p})(?= )", label, priority) for k, also, p, label, priority in out]


def keyword_pattern(keywords: Iterable[str]) -> str:
    """Finds, at the start of each word, the longest keyword that stands there (group 1); words are not consumed.

    A keyword ends with a word, but for those that a version follows at once ("gplv"). Keywords of one
    first letter share a branch.
    """
    by_letter: dict[str, list[str]] = {}
    for k in sorted(keywords, key=lambda k: (-len(k), k)):
        by_letter.setdefault(k[0], []).append(k[1:] + ("" if k.endswith("plv") else "(?= )"))
    return " (?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + "))"


def _by_keyword() -> dict[str, list[dict]]:
    """The rules that a text with a keyword may match: those of the keyword and of keywords that it begins with."""
    own: dict[str, list[dict]] = {k: [] for k in BASE}
    for i, r in enumerate(rules()):
        own.setdefault(r.keyword, []).append({"rule": i, "also": r.also, "pattern": r.pattern, "label": r.label, "priority": r.priority})
    return {k: [r for other, rs in own.items() if k.startswith(other) for r in rs] for k in own}


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _detections(words: Column, keywords: Column) -> Column:
    """Array of (start, end, priority, rule, label): every match of every rule whose keyword is present."""
    # a constant, made when the plan is
    table = F.from_json(F.lit(json.dumps(_by_keyword())), "map<string,array<struct<rule:int,also:string,pattern:string,label:string,priority:int>>>")
    near = F.array_distinct(F.flatten(F.transform(F.array_distinct(keywords), lambda k: F.element_at(table, k))))
    present = F.filter(near, lambda r: F.contains(words, r["also"]))

    def matches(r: Column) -> Column:
        pairs = F.arrays_zip(F.split(words, r["pattern"], -1).alias("gap"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("text"))
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            end = start + F.coalesce(F.length(x["text"]), F.lit(0))
            found = F.when(x["text"].isNotNull(), F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
        # in this order of fields detections sort by start, the longest first, then by rule
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), r["rule"].alias("rule"), m["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label")))

    return F.flatten(F.transform(present, matches))


def _kept(inside: Column) -> Column:
    """Of detections in order, those that no other overrules: two sweeps, each with one number for each priority.

    Forwards it is how far detections before reach: one of the same priority that reaches this one's end
    contains it, one of a higher that reaches beyond its start overlaps it. Backwards it is where the next
    detection begins: one of a higher priority that begins before this one's end overlaps it.
    """
    no_flags = F.array().cast("array<boolean>")

    def sweep(items: Column, first: int, better, over) -> Column:  # noqa: ANN001
        def step(s: Column, d: Column) -> Column:
            state = F.transform(s["state"], lambda m, i: F.when(i == d["priority"], better(m, d)).otherwise(m))
            return F.struct(state.alias("state"), F.concat(s["flags"], F.array(F.coalesce(over(s["state"], d), F.lit(False)))).alias("flags"))

        begin = F.struct(F.array_repeat(F.lit(first), TOP + 1).alias("state"), no_flags.alias("flags"))
        return F.aggregate(items, begin, step, lambda s: s["flags"])

    higher = lambda state, d: F.slice(state, d["priority"] + 2, F.lit(TOP + 1))
    ahead = sweep(inside, -1, lambda m, d: F.greatest(m, d["end"]), lambda m, d: (F.get(m, d["priority"]) >= d["end"]) | F.coalesce(F.array_max(higher(m, d)) > d["start"], F.lit(False)))
    behind = sweep(F.reverse(inside), 1 << 30, lambda m, d: F.least(m, d["start"]), lambda m, d: F.array_min(higher(m, d)) < d["end"])
    flagged = F.arrays_zip(inside.alias("d"), ahead.alias("a"), F.reverse(behind).alias("b"))
    kept = F.filter(flagged, lambda x: ~x["a"] & ~x["b"])
    return F.transform(kept, lambda x: F.struct(*[x["d"][n].alias(n) for n in ("start", "end", "priority", "rule", "label")]))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, detections, labels, score), a row for each row.

    Words are runs of other than ASCII controls, blanks and punctuation. n_base counts the places of base
    phrases, first_word and last_word are the smallest and largest word (from 0) at which one starts, or
    null; base are their labels. detections are those kept of the rules, in characters of the normalised
    text, labels the distinct labels of both, sorted. score is 0 with no label, else from 0.4 to 1 by the
    highest priority. Null and empty texts have no words; repeated rows and null ids keep their rows; an
    empty table gives an empty one.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _GAP, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("plain"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(_spaces(F.col("plain")) + 1).cast("long")
    # "^" is in no word: it keeps a match from standing first, where split() would leave out the gap
    low = F.concat(F.lit("^ "), F.translate("plain", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" "))
    rows = rows.select("doc_id", n_words.alias("n_words"), low.alias("low"))
    rows = rows.select("*", F.regexp_extract_all("low", F.lit(keyword_pattern(_by_keyword())), F.lit(1)).alias("keywords"))
    rows = rows.select("doc_id", "n_words", "keywords", F.when(F.size("keywords") > 0, F.col("low")).alias("words"))
    at_phrase = "(?= (?:" + "|".join(BASE) + ") )"
    rows = rows.select("*", F.coalesce(F.split("words", at_phrase, -1), F.array(F.lit(""))).alias("pieces"), F.array_sort(_detections(F.col("words"), F.col("keywords"))).alias("found"))
    # a column of its own, since it is read several times
    rows = rows.select("doc_id", "n_words", "words", "pieces", F.coalesce(_kept(F.col("found")), F.array()).alias("detections"))
    any_base = F.size("pieces") > 1
    base = F.array_compact(F.array(*[F.when(F.contains("words", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items()]))
    rows = rows.select(
        "doc_id",
        "n_words",
        (F.size("pieces") - 1).cast("long").alias("n_base"),
        F.when(any_base, _spaces(F.col("pieces")[0])).cast("long").alias("first_word"),
        F.when(any_base, F.col("n_words") + 1 - _spaces(F.element_at("pieces", -1))).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
        "detections",
    )
    named = F.transform("detections", lambda d: d["label"])
    top = F.greatest(F.when(F.size("base") > 0, 2), F.array_max(F.transform("detections", lambda d: d["priority"])))
    return rows.select("*", F.array_sort(F.array_union("base", named)).alias("labels"), F.coalesce(0.25 + 0.15 * top, F.lit(0.0)).alias("score"))
