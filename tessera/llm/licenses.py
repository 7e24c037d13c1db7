"""License scans: ordered signature rules over normalised words, in DataFrame functions only.

Each rule has a keyword; its regex runs only on texts that hold the keyword, and no rule runs on a text without any mark of a licence. A detection
whose words lie within those of another is dropped; of equal detections the rule that comes first stands. The rules are the products of licences'
names and phrasings, in order of priority, then standard notices and passages of licences' bodies, and signatures written out one by one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that count for themselves, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licences: label, keyword (a substring of the normalised text), name as a regex over words that single spaces part. More exact names come first.
LICENSES = (
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: v(?:ersion)? ?3)?(?: 0)?"),
    ("agpl-3", "agpl", r"agpl ?v?3?(?: 0)?(?: only| or later)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[sc]e v(?:ersion)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e(?: v(?:ersion)? ?2 1)?"),
    ("lgpl-2", "library general", r"(?:gnu )?library general public licen[sc]e(?: v(?:ersion)? ?2)?(?: 0)?"),
    ("lgpl-3", "lgpl", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: ?v?2 1)?(?: only| or later)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: v(?:ersion)?)? ?1 1"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit", "expat", r"expat(?: x11)?"),
    ("x11", "x11", r"x11"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("isc", "isc", r"isc"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: v(?:ersion)?)? ?1 1"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e(?: v(?:ersion)?)?(?: ?1)?(?: 0)?"),
    ("cddl-1", "cddl", r"(?:common development and distribution licen[sc]e )?cddl(?: v?1)?(?: [01])?"),
    ("eupl-1.2", "eupl", r"(?:european union public licen[sc]e )?eupl(?: v?1 2)?"),
    ("artistic-2", "artistic", r"artistic licen[sc]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic(?: licen[sc]e)?(?: 1 0)?"),
    ("bsl-1", "boost", r"boost software licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2", "python software", r"python software foundation(?: licen[sc]e)?(?: v(?:ersion)? ?2)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: v(?:ersion)?)?(?: 1 1)?"),
    ("odbl-1", "database licen", r"open (?:data commons open )?database licen[sc]e(?: v?1 0)?"),
    ("cc0-1", "cc0", r"(?:creative commons (?:zero )?)?cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?"),
)

#: Verbs of the phrasing that may go without the word licence.
GIVEN = "released|distributed|available|published|provided|covered|shared|offered"

#: Phrasings: a regex in which @ is the name, and how sure a match is.
PHRASINGS = (
    (r"(?:licen[sc]ed|dual licen[sc]ed|re ?licen[sc]ed) (?:under|by|with|as) (?:(?:the|a) )?(?:terms (?:and conditions )?of (?:the )?)?@(?: (?:international|public))?(?: licen[sc]e)?", 1.0),
    (rf"(?:{GIVEN}) (?:under|by) (?:(?:the|a) )?(?:terms (?:and conditions )?of (?:the )?)?@(?: (?:international|public))?(?: licen[sc]e)?", 0.95),
    (r"spdx licen[sc]e identifier @", 1.0),
    (r"(?:subject to|according to|in accordance with|see|under) (?:the )?(?:terms of (?:the )?)?@ licen[sc]e", 0.9),
    (r"(?:licen[sc]e|licen[sc]es|licen[sc]ing) (?:is |are |type )?(?:the )?@", 0.8),
    (r"@ licen[sc]e", 0.7),
)

#: Notices and passages of bodies: label, keyword (words that every match holds), regex, how sure a match is. More exact ones come first.
NOTICES = (
    *((label, "published by the free software foundation", rf"redistribute it and or modify it under the terms of the gnu {kind}general public licen[sc]e as published by the free software foundation(?: inc)? (?:either )?version {v}(?: 0)?(?: of the licen[sc]e)?(?: or at your option any later version)?", 1.0) for label, kind, v in (("gpl-3", "", "3"), ("gpl-2", "", "2"), ("agpl-3", "affero ", "3"), ("lgpl-3", "lesser ", "3"), ("lgpl-2.1", "lesser ", "2 1"), ("lgpl-2", "library ", "2"))),
    ("gpl-3", "is a free copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 1.0),
    ("agpl-3", "is a free copyleft", r"the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 1.0),
    ("lgpl-3", "version of the gnu lesser", r"this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e", 1.0),
    ("gpl-2", "by contrast the gnu", r"by contrast the gnu general public licen[sc]e is intended to guarantee your freedom to share and change free software", 0.95),
    ("lgpl-2.1", "by contrast the gnu", r"by contrast the gnu general public licen[sc]es are intended to guarantee your freedom to share and change free software", 0.8),
    ("apache-2", "except in compliance with the license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "use reproduction and distribution", r"apache license version 2 0 january 2004(?: https?)?(?: www apache org licenses)? terms and conditions for use reproduction and distribution", 1.0),
    ("mpl-2", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", 1.0),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so(?! subject)", 0.95),
    ("bsl-1", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 1.0),
    ("ofl-1.1", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 1.0),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 1.0),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd-3-clause", "endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 1.0),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "you want to public", r"do what the fuck you want to public licen[sc]e", 1.0),
    ("cc0-1", "associated a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
)

#: More signatures, written out one by one: headers, titles, short forms and statements that name no licence by the phrasings above.
SIGNATURES = (
    ("agpl-3", "affero general public", r"gnu affero general public licen[sc]e version 3 19 november 2007", 1.0),
    ("gpl-3", "general public", r"gnu general public licen[sc]e version 3 29 june 2007", 1.0),
    ("gpl-2", "general public", r"gnu general public licen[sc]e version 2 june 1991", 1.0),
    ("gpl-1", "general public", r"gnu general public licen[sc]e version 1 february 1989", 1.0),
    ("lgpl-3", "lesser general public", r"gnu lesser general public licen[sc]e version 3 29 june 2007", 1.0),
    ("lgpl-2.1", "lesser general public", r"gnu lesser general public licen[sc]e version 2 1 february 1999", 1.0),
    ("lgpl-2", "library general public", r"gnu library general public licen[sc]e version 2 june 1991", 1.0),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e version 1 3", 1.0),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[sc]e version 1 2", 1.0),
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e", 0.95),
    ("gpl-3", "gplv3", r"gplv3", 0.9),
    ("gpl-2", "gplv2", r"gplv2", 0.9),
    ("lgpl-3", "lgplv3", r"lgplv3", 0.9),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?", 0.9),
    ("agpl-3", "agplv3", r"agplv3", 0.9),
    ("gpl", "you should have received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e along with this", 0.9),
    ("lgpl", "you should have received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e along with this", 0.9),
    ("agpl-3", "you should have received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e along with this", 0.95),
    ("apache-2", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0", 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.8),
    ("apache-2", "asf licenses this file", r"the asf licenses this file to you under the apache license version 2 0", 1.0),
    ("apache-2", "apache licensed", r"apache licensed", 0.7),
    ("mit", "mit licensed", r"mit licensed", 0.8),
    ("mit", "opensource org licenses", r"opensource org licenses mit(?: license)?", 1.0),
    ("mit-0", "mit no attribution", r"mit no attribution", 0.95),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 0.95),
    ("mit", "the above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("bsd", "bsd licensed", r"bsd licensed", 0.8),
    ("bsd-2-clause", "opensource org licenses", r"opensource org licenses bsd 2 clause", 1.0),
    ("bsd-3-clause", "opensource org licenses", r"opensource org licenses bsd 3 clause", 1.0),
    ("bsd", "opensource org licenses", r"opensource org licenses bsd license", 0.9),
    ("bsd", "bsd style", r"bsd style licen[sc]e", 0.9),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85),
    ("bsd-3-clause", "nor the names of its contributors", r"nor the names of its contributors may be used to endorse or promote products", 0.9),
    ("isc", "internet systems consortium", r"copyright (?:c )?[0-9 ]{4,20}by internet systems consortium inc", 0.8),
    ("isc", "opensource org licenses", r"opensource org licenses isc", 1.0),
    ("zlib", "opensource org licenses", r"opensource org licenses zlib", 1.0),
    ("zlib", "altered source versions must be", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("bsl-1", "boost org license", r"boost org license 1 0(?: txt)?", 1.0),
    ("bsl-1", "boost software", r"boost software licen[sc]e version 1 0 august 17th 2003", 1.0),
    ("mpl-2", "mozilla org mpl 2", r"mozilla org mpl 2 0", 1.0),
    ("mpl-1.1", "mozilla org mpl 1", r"mozilla org mpl (?:mpl )?1 1", 1.0),
    ("mpl-1.1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("epl-2", "eclipse org legal epl", r"eclipse org legal epl 2 0", 1.0),
    ("epl-1", "eclipse org legal epl", r"eclipse org legal epl v10", 1.0),
    ("epl-2", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0", 1.0),
    ("epl-1", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0", 1.0),
    ("cddl-1", "common development and distribution", r"common development and distribution licen[sc]e(?: cddl)?(?: v(?:ersion)? ?1 [01])?", 0.95),
    ("cpl-1", "common public", r"common public licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", 0.95),
    ("ipl-1", "ibm public", r"ibm public licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", 0.95),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e(?: v(?:ersion)?)? ?1 2", 1.0),
    ("eupl-1.1", "european union public", r"european union public licen[sc]e(?: v(?:ersion)?)? ?1 1", 1.0),
    ("osl-3", "open software licen", r"open software licen[sc]e(?: v(?:ersion)?)? ?3(?: 0)?", 1.0),
    ("afl-3", "academic free", r"academic free licen[sc]e(?: v(?:ersion)?)? ?3(?: 0)?", 1.0),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e(?: ms pl)?", 0.95),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e(?: ms rl)?", 0.95),
    ("ncsa", "university of illinois", r"university of illinois(?: ncsa)? open source licen[sc]e", 0.95),
    ("php-3", "php licen", r"php licen[sc]e(?: v(?:ersion)?)? ?3(?: 0[01]?)?", 0.95),
    ("ruby", "ruby", r"same terms as ruby(?: itself)?", 0.85),
    ("perl", "perl", r"same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)?(?: itself)?", 0.9),
    ("artistic-1", "artistic", r"the artistic licen[sc]e preamble the intent of this document", 1.0),
    ("artistic-2", "perlfoundation org", r"perlfoundation org artistic license 2 0", 1.0),
    ("vim", "vim licen", r"vim licen[sc]e", 0.85),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.95),
    ("openssl", "openssl", r"openssl licen[sc]e", 0.9),
    ("libpng", "libpng", r"(?:png reference library|libpng) licen[sc]e(?: version 2)?", 0.9),
    ("curl", "daniel stenberg", r"copyright (?:c )?[0-9 ]{4,20}daniel stenberg", 0.7),
    ("postgresql", "postgresql global development", r"portions copyright (?:c )?[0-9 ]{4,20}(?:the )?postgresql global development group", 0.9),
    ("beerware", "beer", r"the beer ware licen[sc]e(?: revision 42)?", 1.0),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 0.95),
    ("wtfpl", "what the fuck you want", r"you just do what the fuck you want to", 0.95),
    ("wtfpl", "wtfpl net", r"wtfpl net", 0.9),
    ("unlicense", "unlicense org", r"unlicense org", 0.95),
    ("public-domain", "public domain", r"(?:is|are|been|was|were|hereby)(?: hereby)? (?:placed|released|put|dedicated) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "public domain", r"this (?:work|file|code|software|text|document) is (?:in the )?public domain", 0.9),
    ("public-domain", "public domain", r"dedicate[sd]? (?:any and )?(?:all )?copyright interest in (?:the|this) software to the public domain", 0.95),
    ("cc0-1", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("cc0-1", "cc0 1", r"cc0 1 0 universal", 1.0),
    ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by [1-4] [05]", 1.0),
    ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa [1-4] [05]", 1.0),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd [1-4] [05]", 1.0),
    ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses", r"creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses", r"creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", 0.95),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 0.95),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", 0.9),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", 0.95),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?", 0.95),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?", 0.85),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd [1-4] [05]", 0.95),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa [1-4] [05]", 0.95),
    ("cc-by-nc", "cc by nc", r"cc by nc [1-4] [05]", 0.95),
    ("cc-by-nd", "cc by nd", r"cc by nd [1-4] [05]", 0.95),
    ("cc-by-sa", "cc by sa", r"cc by sa [1-4] [05]", 0.95),
    ("cc-by", "cc by", r"cc by [1-4] [05]", 0.95),
    ("odbl-1", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?", 1.0),
    ("odc-by-1", "opendatacommons org licenses by", r"opendatacommons org licenses by(?: 1 0)?", 1.0),
    ("pddl-1", "opendatacommons org licenses pddl", r"opendatacommons org licenses pddl(?: 1 0)?", 1.0),
    ("ogl-3", "open government", r"open government licen[sc]e(?: v(?:ersion)? ?3)?(?: 0)?", 0.95),
    ("ofl-1.1", "scripts sil org ofl", r"scripts sil org ofl", 1.0),
    ("cdla-permissive-2", "community data", r"community data licen[sc]e agreement permissive(?: version 2 0)?", 0.95),
    ("cdla-sharing-1", "community data", r"community data licen[sc]e agreement sharing(?: version 1 0)?", 0.95),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?", 0.85),
    ("sspl-1", "server side public", r"server side public licen[sc]e(?: v(?:ersion)?)?(?: ?1)?", 0.95),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: v(?:ersion)?)?(?: ?1 1)?", 0.95),
    ("elastic-2", "elastic licen", r"elastic licen[sc]e(?: v(?:ersion)?)?(?: ?2)?(?: 0)?", 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)? condition", 0.95),
    ("polyform-noncommercial-1", "polyform", r"polyform noncommercial licen[sc]e(?: 1 0 0)?", 0.95),
    ("json", "good not evil", r"the software shall be used for good not evil", 1.0),
    ("upl-1", "universal permissive", r"universal permissive licen[sc]e(?: v(?:ersion)?)?(?: ?1)?(?: 0)?", 0.95),
    ("blueoak-1", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", 0.95),
    ("cecill-2.1", "cecill", r"cecill(?: v(?:ersion)?)? ?2 1", 0.95),
    ("cecill", "cecill", r"cecill(?: [bc])? free software licen[sc]e(?: agreement)?", 0.9),
    ("mulan-2", "mulan", r"mulan (?:permissive software licen[sc]e|psl) ?v?2", 0.95),
    ("zpl-2.1", "zope public", r"zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 1)?", 0.95),
    ("w3c", "w3c software", r"w3c software (?:notice )?(?:and|document)(?: notice and)? licen[sc]e", 0.9),
    ("icu", "unicode inc", r"unicode inc licen[sc]e agreement data files and software", 0.95),
    ("all-rights-reserved", "all rights reserved", r"copyright (?:c )?[0-9]{4}(?: [0-9]{4})?(?: [^ ]+){1,8}? all rights reserved", 0.6),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.7),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
)

#: Further licences of an identifier's expression, after the first one.
EXPRESSION = r"(?<= spdx licen[sc]e identifier [a-z0-9 ]{1,80}) (?:or|and) @"

#: What parts words in a text as it is.
PARTING = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A text that fits none of these pairs holds no base phrase and fits no rule: a word to look for, and an expression for texts that hold it. All phrasings hold licen[sc]
#: but that with the verbs, and all base phrases but cc by nc; a notice or signature that need not hold these has its keyword.
MARKS = (
    ("licens", ""), ("licenc", ""), ("cc", f"cc{GAP}by{GAP}"), *((verb, f"{verb}{GAP}(?:under|by){GAP}") for verb in GIVEN.split("|")),
    *sorted({(max(keyword.split(), key=len), keyword.replace(" ", GAP)) for _, keyword, pattern, _ in (*NOTICES, *SIGNATURES) if "licen" not in pattern}),
)


def rules() -> list[dict]:
    """All rules in order: names in phrasings, notices, signatures, further licences of an expression, and last the base phrases, as detections of their own."""
    out = [{"rule": i * len(LICENSES) + k, "label": label, "keyword": keyword, "pattern": f" {phrase.replace('@', name)}(?= )", "sure": sure} for i, (phrase, sure) in enumerate(PHRASINGS) for k, (label, keyword, name) in enumerate(LICENSES)]
    out += [{"rule": len(out) + i, "label": label, "keyword": keyword, "pattern": f" {pattern}(?= )", "sure": sure} for i, (label, keyword, pattern, sure) in enumerate((*NOTICES, *SIGNATURES))]
    out += [{"rule": len(out) + i, "label": label, "keyword": "spdx licen", "pattern": f"{EXPRESSION.replace('@', name)}(?= )", "sure": 1.0} for i, (label, _, name) in enumerate(LICENSES)]
    return out + [{"rule": len(out) + i, "label": label, "keyword": phrase, "pattern": f" {phrase}(?= )", "sure": 0.9} for i, (phrase, label) in enumerate(BASE)]


def normalised(text: Column) -> Column:
    """A-Z lowered, words parted by single spaces, a space at either end."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def places(norm: Column, pattern: Column) -> Column:
    """Starts and ends (words, from 0; the end is not included) of a pattern's matches, each of which begins with a space."""
    parts, found = F.split(norm, pattern, -1), F.regexp_extract_all(norm, pattern, F.lit(0))
    each = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("hit"))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + _spaces(x["part"])
        stop = start + _spaces(x["hit"])
        return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(each, first, add, lambda acc: acc["out"])).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int>>)"))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (array of places of the base phrases: start, stop, label) and detections (start, stop, rule, label, sure: those that stand, in order).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered. A null text has none. Columns of docs named like these are replaced.
    """
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<rule:int,label:string,keyword:string,pattern:string,sure:double>>")
    base = F.from_json(F.lit(json.dumps([{"pattern": f" {p}(?= )", "label": x} for p, x in BASE])), "array<struct<pattern:string,label:string>>")
    none_base = "cast(array() as array<struct<start:int,stop:int,label:string>>)"
    none = "cast(array() as array<struct<start:int,length:int,rule:int,stop:int,label:string,sure:double>>)"
    text = F.coalesce(F.col("text"), F.lit(""))
    # all that parts words becomes a blank, and what blanks part is counted: far cheaper than by an expression
    out = docs.withColumn("n_words", F.size(F.array_remove(F.split(F.translate(text, PARTING, " " * len(PARTING)), " "), "")).cast("long"))
    low = F.col("_low")  # words are looked for one by one, which is cheaper than by one expression
    out = out.withColumn("_low", F.lower(text))
    marked = reduce(Column.__or__, [F.contains(low, F.lit(w)) & (low.rlike(x) if x else F.lit(True)) for w, x in MARKS])
    out = out.withColumn("_norm", F.when(marked, normalised(text)))
    norm = F.col("_norm")
    out = out.withColumn("base", F.when(norm.isNotNull(), F.flatten(F.transform(base, lambda b: F.transform(places(norm, b["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), b["label"].alias("label")))))).otherwise(F.expr(none_base)))
    # in order of start, then the longest, then the rule: -length sorts the longest first
    found = F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["keyword"])), lambda r: F.transform(places(norm, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (p["start"] - p["stop"]).alias("length"), r["rule"].alias("rule"), p["stop"].alias("stop"), r["label"].alias("label"), r["sure"].alias("sure")))))
    out = out.withColumn("_found", F.when(norm.isNotNull(), F.array_sort(found)).otherwise(F.expr(none)))
    # the largest end before each detection: one that ends no later lies within an earlier one
    ends = F.aggregate("_found", F.array(F.lit(-1)), lambda acc, x: F.array_append(acc, F.greatest(F.element_at(acc, -1), x["stop"])))
    out = out.withColumn("_ends", F.when(F.size("_found") > 0, ends))
    return out.withColumn("detections", F.filter("_found", lambda x, i: F.get(F.col("_ends"), i) < x["stop"])).drop("_low", "_norm", "_found", "_ends")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the surest detection's certainty, 0 without one."""
    start = F.transform("base", lambda x: x["start"])
    base_labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    labels = F.array_distinct(F.concat(base_labels, F.transform("detections", lambda x: x["label"])))
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"), F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda x: x["sure"])), F.lit(0.0)).alias("score"))
