"""License scans: ordered signature rules behind a keyword filter, with suppression of contained detections. Built-in functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Carried

# Phrases that are always looked for, and their labels.
BASE_PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licences: label, name as a regex over lower-case words, and the words that it can begin with.
LICENCES: list[tuple[str, str, str]] = [
    ("0bsd", r"(?:0bsd|bsd zero clause)", "0bsd bsd"),
    ("afl-3", r"academic free(?: license)?(?: version 3| v3)?", "academic"),
    ("agpl-3", r"(?:gnu affero general public(?: license)?(?: version 3| v3)?|agpl ?v?3|affero gpl)", "gnu agpl agplv3 agpl3 affero"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache apache2"),
    ("artistic-2", r"(?:perl )?artistic(?: license)?(?: version)? 2(?: 0)?", "artistic perl"),
    ("beerware", r"(?:beerware|beer ware)", "beerware beer"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd 2 simplified freebsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 new modified revised"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd 4 original"),
    ("bsl-1", r"boost software(?: license)?(?: version)?(?: 1(?: 0)?)?", "boost"),
    ("bsl-1.1", r"business source(?: license)?(?: 1 1)?", "business"),
    ("cc-by-4", r"(?:cc by(?: 4 0| 3 0)?|creative commons attribution)", "cc creative"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "cc creative"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", "cc creative"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc creative"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", "cc creative"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc creative"),
    ("cc0-1", r"(?:cc0(?: 1 0)?|creative commons zero)", "cc0 creative"),
    ("cddl-1", r"(?:common development and distribution|cddl(?: 1 0)?)", "common cddl"),
    ("cecill-2", r"cecill(?: 2(?: 1)?)?", "cecill"),
    ("cpl-1", r"common public(?: license)?(?: version 1)?", "common"),
    ("ecl-2", r"educational community(?: license)?(?: version 2)?", "educational"),
    ("efl-2", r"eiffel forum(?: license)?(?: version 2)?", "eiffel"),
    ("epl-1", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?", "eclipse"),
    ("epl-2", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?", "eclipse"),
    ("eupl-1.2", r"(?:european union public(?: licence)?|eupl(?: 1 2)?)", "european eupl"),
    ("gfdl-1.3", r"gnu free documentation(?: license)?(?: version 1 3)?", "gnu"),
    ("gpl-1", r"(?:gnu general public license version 1|gpl ?v?1)", "gnu gpl gplv1 gpl1"),
    ("gpl-2", r"(?:gnu general public(?: license)?(?: version| v) ?2|gpl ?v?2)", "gnu gpl gplv2 gpl2"),
    ("gpl-3", r"(?:gnu general public(?: license)?(?: version| v) ?3|gpl ?v?3)", "gnu gpl gplv3 gpl3"),
    ("gpl", r"gnu general public", "gnu"),
    ("hpnd", r"historical permission notice", "historical"),
    ("isc", r"(?:isc|internet systems consortium)", "isc internet"),
    ("jpl", r"json", "json"),
    ("lgpl-2.1", r"(?:gnu lesser general public(?: license)?(?: version| v) ?2(?: 1)?|lgpl ?v?2(?: 1)?)", "gnu lgpl lgplv2 lgpl2"),
    ("lgpl-3", r"(?:gnu lesser general public(?: license)?(?: version| v) ?3|lgpl ?v?3)", "gnu lgpl lgplv3 lgpl3"),
    ("lgpl", r"gnu (?:lesser|library) general public", "gnu"),
    ("lppl-1.3c", r"latex project public", "latex"),
    ("mit", r"(?:mit|expat|x11)", "mit expat x11"),
    ("mit-0", r"(?:mit 0|mit no attribution)", "mit"),
    ("mpl-1.1", r"(?:mozilla public(?: license)?(?: version| v)? 1 1|mpl 1 1)", "mozilla mpl"),
    ("mpl-2", r"(?:mozilla public(?: license)?(?: version| v)? 2(?: 0)?|mpl 2(?: 0)?)", "mozilla mpl"),
    ("ms-pl", r"microsoft public", "microsoft"),
    ("ms-rl", r"microsoft reciprocal", "microsoft"),
    ("ncsa", r"(?:university of illinois ncsa(?: open source)?|ncsa)", "university ncsa"),
    ("odbl-1", r"(?:open database|odbl(?: 1 0)?)", "open odbl"),
    ("odc-by", r"open data commons attribution", "open"),
    ("ofl-1.1", r"(?:sil open font|ofl(?: 1 1)?)", "sil ofl"),
    ("openssl", r"openssl", "openssl"),
    ("osl-3", r"open software(?: license)?(?: version 3| v3)?", "open"),
    ("php-3", r"php(?: version 3(?: 01)?| 3(?: 01)?)?", "php"),
    ("postgresql", r"postgresql", "postgresql"),
    ("psf-2", r"python software foundation(?: license)?(?: version 2)?", "python"),
    ("ruby", r"ruby", "ruby"),
    ("sspl-1", r"server side public", "server"),
    ("unlicense", r"unlicense", "unlicense"),
    ("upl-1", r"universal permissive", "universal"),
    ("vim", r"vim", "vim"),
    ("w3c", r"w3c(?: software)?(?: notice)?", "w3c"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl do"),
    ("zlib", r"(?:zlib|zlib libpng)", "zlib"),
    ("zpl-2.1", r"zope public(?: license)?(?: version)?(?: 2 1)?", "zope"),
]

# Openings and clauses of licence texts, header notices, addresses and other notices: label, regex, first words, confidence.
NOTICES: list[tuple[str, str, str, float]] = [
    ("all-rights-reserved", r"rights reserved", "rights", 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.5),
    ("public-domain", r"public domain", "public", 0.8),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary confidential", 0.7),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution", 0.9),
    ("gpl", r"program is free software you can redistribute it and or modify it", "program", 0.9),
    ("mpl-2", r"source code form is subject to the terms of the mozilla public license", "source", 0.95),
    ("unlicense", r"unencumbered software released into the public domain", "unencumbered", 0.95),
    ("zlib", r"software is provided as is without any express or implied warranty", "software", 0.7),
    ("mit", r"above copyright notice and this permission notice shall be included in all copies", "above", 0.9),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission", 0.95),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "permission", 0.9),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted", "permission", 0.85),
    ("ncsa", r"deal with the software without restriction", "deal", 0.85),
    ("apache-2", r"obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", "obtain", 0.95),
    ("apache-2", r"apache org licenses license 2 0", "apache", 0.9),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", "unless", 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", 0.85),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.85),
    ("bsd-3-clause", r"neither the name of (?:[a-z0-9]+ ){1,8}nor the names of (?:its|their|the) contributors", "neither", 0.95),
    ("bsd-4-clause", r"advertising materials mentioning features or use of this software must display", "advertising", 0.95),
    ("gpl-2", r"either version 2 of the license or (?:at your option )?any later version", "either", 0.8),
    ("gpl-3", r"either version 3 of the license or (?:at your option )?any later version", "either", 0.8),
    ("lgpl-2.1", r"either version 2 1 of the license or (?:at your option )?any later version", "either", 0.85),
    ("gpl", r"received a copy of the gnu general public license along with", "received", 0.9),
    ("lgpl", r"received a copy of the gnu (?:lesser|library) general public license along with", "received", 0.9),
    ("agpl-3", r"received a copy of the gnu affero general public license along with", "received", 0.9),
    ("gpl-3", r"gnu org licenses gpl 3 0", "gnu", 0.9),
    ("gpl-2", r"gnu org licenses (?:old licenses )?gpl 2 0", "gnu", 0.9),
    ("lgpl-3", r"gnu org licenses lgpl 3 0", "gnu", 0.9),
    ("agpl-3", r"gnu org licenses agpl 3 0", "gnu", 0.9),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "everyone", 0.8),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "everyone", 0.95),
    ("mpl-1.1", r"contents of this file are subject to the mozilla public license version 1 1", "contents", 0.95),
    ("mpl-2", r"mozilla org mpl 2 0", "mozilla", 0.9),
    ("epl-1", r"accompanying materials are made available under the terms of the eclipse public license v1 0", "accompanying", 0.95),
    ("epl-2", r"accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", "accompanying", 0.95),
    ("cddl-1", r"subject to the terms of the common development and distribution license", "subject", 0.95),
    ("lppl-1.3c", r"under the conditions of the latex project public license", "under", 0.95),
    ("zlib", r"origin of this software must not be misrepresented", "origin", 0.95),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", 0.95),
    ("openssl", r"product includes software developed by the openssl project", "product", 0.95),
    ("php-3", r"product includes php software freely available from", "product", 0.95),
    ("ofl-1.1", r"font software is licensed under the sil open font license", "font", 0.95),
    ("ofl-1.1", r"with reserved font name", "with", 0.8),
    ("unlicense", r"unlicense org", "unlicense", 0.9),
    ("cc-by-4", r"creativecommons org licenses by (?:4|3) 0", "creativecommons", 0.95),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons", 0.95),
    ("cc-by-nc", r"creativecommons org licenses by nc", "creativecommons", 0.9),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons", 0.95),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons", 0.95),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons", 0.95),
    ("cc0-1", r"creativecommons org publicdomain zero", "creativecommons", 0.95),
    ("cc-by-4", r"attribution 4 0 international", "attribution", 0.8),
    ("cc-by-sa", r"attribution share ?alike 4 0 international", "attribution", 0.85),
    ("cc-by-nc", r"attribution non ?commercial 4 0 international", "attribution", 0.85),
    ("cc-by-nc-sa", r"attribution non ?commercial share ?alike 4 0 international", "attribution", 0.85),
    ("elastic-2", r"elastic license 2 0", "elastic", 0.95),
    ("commons-clause", r"commons clause license condition", "commons", 0.95),
    ("bsl-1.1", r"additional use grant", "additional", 0.7),
    ("dual-licence", r"dual licen(?:s|c)ed", "dual", 0.7),
    ("non-commercial", r"for non ?commercial (?:use|purposes) only", "for", 0.7),
    ("non-commercial", r"not for commercial use", "not", 0.7),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", "unauthorized", 0.9),
    ("proprietary", r"contains (?:proprietary|confidential) (?:information|trade secrets)", "contains", 0.7),
    ("eula", r"end user licen(?:s|c)e agreement", "end", 0.8),
    ("licence-file", r"see (?:the )?(?:accompanying )?licen(?:s|c)e (?:file|txt|md)", "see", 0.5),
    # Openings, grants, conditions and disclaimers of further licence texts.
    ("mit", r"software is provided as is without warranty of any kind express or implied including but not limited to", "software", 0.85),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "in", 0.85),
    ("x11", r"name of the x consortium shall not be used in advertising or otherwise", "name", 0.95),
    ("isc", r"software is provided as is and the author disclaims all warranties", "software", 0.9),
    ("isc", r"in no event shall the author be liable for any special direct indirect or consequential damages", "in", 0.8),
    ("bsd", r"software is provided by the (?:copyright holders|regents|author|authors)(?: and contributors)? as is", "software", 0.9),
    ("bsd-2-clause", r"views and conclusions contained in the software and documentation are those of the authors", "views", 0.9),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "may", 0.9),
    ("bsd-4-clause", r"product includes software developed by the university of california berkeley and its contributors", "product", 0.95),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "no", 0.95),
    ("bsd-patent", r"each copyright holder and contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free", "each", 0.9),
    ("apache-2", r"you may not use this file except in compliance with the license", "you", 0.85),
    ("apache-2", r"see the license for the specific language governing permissions and limitations under the license", "see", 0.85),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", "licensed", 0.95),
    ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each", 0.85),
    ("apache-1.1", r"product includes software developed by the apache software foundation", "product", 0.9),
    ("gpl", r"in the hope that it will be useful but without any warranty", "in", 0.8),
    ("gpl-2", r"licenses for most software are designed to take away your freedom to share and change it", "licenses", 0.9),
    ("gpl-3", r"gnu general public license is a free copyleft license for software and other kinds of works", "gnu", 0.95),
    ("agpl-3", r"gnu affero general public license is a free copyleft license for software and other kinds of works", "gnu", 0.95),
    ("agpl-3", r"remote network interaction use with the gnu general public license", "remote", 0.95),
    ("lgpl-2.1", r"first released version of the lesser gpl", "first", 0.9),
    ("lgpl-3", r"incorporates the terms and conditions of version 3 of the gnu general public license", "incorporates", 0.95),
    ("gpl-link-exception", r"as a special exception the copyright holders of this library give you permission to link", "as", 0.95),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission", 0.95),
    ("gfdl-1.3", r"with no invariant sections no front cover texts and no back cover texts", "with", 0.9),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", "if", 0.95),
    ("mpl-2", r"incompatible with secondary licenses as defined by the mozilla public license", "incompatible", 0.9),
    ("mpl-1.1", r"contents of this file may be used under the terms of either the gnu general public license", "contents", 0.85),
    ("epl-1", r"eclipse org legal epl v10", "eclipse", 0.9),
    ("epl-2", r"eclipse org legal epl (?:2 0|v20)", "eclipse", 0.9),
    ("epl-2", r"accompanying program is provided under the terms of this eclipse public license", "accompanying", 0.9),
    ("cpl-1", r"accompanying program is provided under the terms of this common public license", "accompanying", 0.95),
    ("cddl-1", r"you can obtain a copy of the license at (?:usr src )?opensolaris license", "you", 0.9),
    ("artistic-1", r"intent of this document is to state the conditions under which a package may be copied", "intent", 0.95),
    ("artistic-2", r"license establishes the terms under which a given free software package may be copied modified distributed", "license", 0.95),
    ("perl", r"redistribute it and or modify it under the same terms as perl itself", "redistribute", 0.95),
    ("psf-2", r"license agreement is between the python software foundation", "license", 0.95),
    ("psf-2", r"psf hereby grants licensee a nonexclusive royalty free world wide license", "psf", 0.9),
    ("cnri-python", r"cnri hereby grants licensee a nonexclusive royalty free world wide license", "cnri", 0.9),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "you", 0.9),
    ("php-3", r"products derived from this software may not be called php", "products", 0.9),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications", "permission", 0.95),
    ("libpng", r"contributing authors and group 42 inc disclaim all warranties expressed or implied", "contributing", 0.9),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission", 0.95),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", "permission", 0.9),
    ("ijg", r"software is based in part on the work of the independent jpeg group", "software", 0.95),
    ("tcl", r"authors hereby grant permission to use copy modify distribute and license this software and its documentation", "authors", 0.95),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "permission", 0.97),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree", "by", 0.9),
    ("w3c", r"w3 org consortium legal", "w3", 0.85),
    ("vim", r"vim is charityware", "vim", 0.9),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "as", 0.95),
    ("cc0-1", r"has waived all copyright and related or neighboring rights", "has", 0.9),
    ("cc0-1", r"to the extent possible under law", "to", 0.7),
    ("cc0-1", r"laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "laws", 0.95),
    ("cc-by-4", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms", "by", 0.8),
    ("cc-by-nd", r"attribution no ?derivatives 4 0 international", "attribution", 0.9),
    ("cc-by-nc-nd", r"attribution non ?commercial no ?derivatives 4 0 international", "attribution", 0.9),
    ("creative-commons", r"work is licensed under a creative commons", "work", 0.85),
    ("creative-commons", r"some rights reserved", "some", 0.6),
    ("odbl-1", r"opendatacommons org licenses odbl", "opendatacommons", 0.95),
    ("odc-by", r"opendatacommons org licenses by", "opendatacommons", 0.95),
    ("pddl-1", r"opendatacommons org licenses pddl", "opendatacommons", 0.95),
    ("pddl-1", r"open data commons public domain dedication and license", "open", 0.95),
    ("ogl-uk-3", r"open government licence(?: v?3 0)?", "open", 0.9),
    ("etalab-2", r"licence ouverte(?: open licence)?", "licence", 0.9),
    ("fal-1.3", r"free art license(?: 1 3)?", "free", 0.9),
    ("fal-1.3", r"licence art libre(?: 1 3)?", "licence", 0.9),
    ("jpl", r"software shall be used for good not evil", "software", 0.95),
    ("ms-lpl", r"microsoft limited public license", "microsoft", 0.95),
    ("apsl-2", r"apple public source license(?: version)?(?: 2 0)?", "apple", 0.95),
    ("npl-1.1", r"netscape public license(?: version)?(?: 1 1)?", "netscape", 0.95),
    ("ipl-1", r"ibm public license(?: version)?(?: 1 0)?", "ibm", 0.95),
    ("qpl-1", r"q public license(?: version)?(?: 1 0)?", "q", 0.9),
    ("rpl-1.5", r"reciprocal public license(?: version)?(?: 1 5)?", "reciprocal", 0.9),
    ("spl-1", r"sun public license(?: version)?(?: 1 0)?", "sun", 0.95),
    ("watcom-1", r"sybase open watcom public license", "sybase", 0.95),
    ("nasa-1.3", r"nasa open source agreement(?: version)?(?: 1 3)?", "nasa", 0.95),
    ("oset-pl-2", r"oset foundation public license", "oset", 0.95),
    ("cecill-b", r"cecill b(?: free software)? license", "cecill", 0.95),
    ("cecill-c", r"cecill c(?: free software)? license", "cecill", 0.95),
    ("eupl-1.2", r"licensed under the eupl(?: version)? 1 2 or as soon they will be approved", "licensed", 0.97),
    ("mulan-psl-2", r"mulan (?:psl v2|permissive software license(?: version)? 2)", "mulan", 0.95),
    ("blueoak-1", r"blue oak model license(?: version)?(?: 1 0 0)?", "blue", 0.95),
    ("polyform-noncommercial", r"polyform noncommercial license(?: 1 0 0)?", "polyform", 0.95),
    ("polyform-small-business", r"polyform small business license(?: 1 0 0)?", "polyform", 0.95),
    ("polyform-strict", r"polyform strict license(?: 1 0 0)?", "polyform", 0.95),
    ("parity-7", r"parity public license(?: 7 0 0)?", "parity", 0.95),
    ("hippocratic-2", r"hippocratic license(?: version)?(?: 2 1)?", "hippocratic", 0.95),
    ("openrail", r"(?:creativeml )?open ?rail(?: m)? license", "creativeml open openrail", 0.9),
    ("bigscience-rail", r"bigscience (?:open ?)?rail license", "bigscience", 0.95),
    ("llama-community", r"llama \d(?: \d)? community license agreement", "llama", 0.95),
    ("gemma-terms", r"gemma terms of use", "gemma", 0.9),
    ("fsl-1.1", r"functional source license(?: version)?(?: 1 1)?", "functional", 0.95),
    ("fair-source", r"fair source license", "fair", 0.9),
    ("timescale", r"timescale license agreement", "timescale", 0.95),
    ("confluent-community", r"confluent community license", "confluent", 0.95),
    ("redis-source", r"redis source available license", "redis", 0.95),
    ("cockroach-community", r"cockroachdb community license", "cockroachdb", 0.95),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "you", 0.9),
    ("commons-clause", r"does not grant to you the right to sell the software", "does", 0.9),
    ("oracle-bcl", r"oracle binary code license agreement", "oracle", 0.95),
    ("sun-bcl", r"sun microsystems inc binary code license agreement", "sun", 0.95),
    ("proprietary", r"retains? all intellectual property and proprietary rights in and to this software", "retain retains", 0.85),
    ("proprietary", r"may not be (?:copied|reproduced|disclosed)(?: or distributed)? without (?:the )?(?:express |prior )?written permission", "may", 0.8),
    ("proprietary", r"trade secrets? and (?:is|are) protected by copyright law", "trade", 0.8),
    ("non-commercial", r"for (?:academic|research|educational|evaluation) purposes only", "for", 0.7),
    ("no-derivatives", r"no derivative works(?: are)? (?:permitted|allowed)", "no", 0.7),
    ("no-redistribution", r"do not redistribute", "do", 0.6),
    ("shareware", r"(?:this is|distributed as) shareware", "this distributed", 0.7),
    ("freeware", r"(?:this is|distributed as) freeware", "this distributed", 0.7),
    ("nda", r"non ?disclosure agreement", "non nondisclosure", 0.7),
    ("copyleft", r"copyleft", "copyleft", 0.5),
]

LICENCE = r"(?:license|licence)"
GRANT = r"(?:licensed|released|distributed|available|published|provided|covered) under(?: the)?(?: terms of)?(?: the)?"
#: Words that a rule sees from its first word on.
CONTEXT = 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
SEPARATOR_BOTH = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No rule and no base phrase matches a text without one of these, in lower case; "under" is the one word that all grants hold.
GATE = ("licen", "under", "copyright", "public", "rights", "proprietary", "permission", "redistribut", "unencumbered", "software", "apache", "gpl", "spdx", "contributors", "altered", "reserved", "creativecommons", "attribution", "grant", "commercial", "prohibited", "confidential", "mozilla", "consortium", "warrant", "liab", "patent", "invariant", "mpl", "eclipse", "charityware", "notice", "agreement", "mulan", "gemma", "purposes", "derivative", "shareware", "freeware", "copyleft", "trade")
#: Or without both of these.
GATE_PAIR = ("cc", "by")


@dataclass(frozen=True)
class Rule:
    """A regex over words joined by one blank, from a word in `first` on; the lower `order` wins where intervals are equal."""

    order: int
    label: str
    first: str
    pattern: str
    score: float


def rules() -> list[Rule]:
    """Each licence in the ways that texts name one, the surest first, then other notices."""
    out: list[tuple[str, str, str, float]] = []
    for label, name, first in LICENCES:
        out.append((label, rf"spdx license identifier {name}(?: only| or later)?", "spdx", 1.0))
    for label, name, _ in LICENCES:
        out.append((label, rf"{GRANT} {name}(?: {LICENCE})?", "licensed released distributed available published provided covered", 0.95))
    for label, name, first in LICENCES:
        out.append((label, rf"{name} {LICENCE}(?: agreement)?(?: (?:version|v) ?\d+)?", first, 0.9))
    for label, name, _ in LICENCES:
        out.append((label, rf"{LICENCE}(?: is| type| name)? {name}", "license licence", 0.8))
    out += NOTICES
    return [Rule(i, label, first, pattern, score) for i, (label, pattern, first, score) in enumerate(out)]


def anchored(rule: Rule) -> str:
    """The rule's regex from the first word of a context on, up to the end of a word; its words are group 1."""
    return rf"^({rule.pattern})(?: |$)"


def rules_by_word() -> Column:
    """The rules as one literal map: first word to an array of (order, label, anchored pattern, score)."""
    by: dict[str, list[dict]] = {}
    for r in rules():
        for word in r.first.split():
            by.setdefault(word, []).append({"order": r.order, "label": r.label, "pattern": anchored(r), "score": r.score})
    # As JSON it is one small expression, which Spark folds into one literal.
    return F.from_json(F.lit(json.dumps(by)), "map<string, array<struct<order: int, label: string, pattern: string, score: double>>>")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another, counted from 0."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def detections(words: Column, by_word: Column, firsts: list[str]) -> Column:
    """(start, end, order, label, score) of every rule at every word that it can begin with, ends exclusive."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(firsts))

    def match(i: Column) -> Column:
        context = F.array_join(F.slice(words, i + 1, CONTEXT), " ")

        def of(rule: Column) -> Column:
            hit = F.call_function("regexp_extract", context, rule["pattern"], F.lit(1))
            return F.struct(i.alias("start"), (-(i + F.size(F.split(hit, " ")))).alias("minus_end"), rule["order"].alias("order"), rule["label"].alias("label"), rule["score"].alias("score"), (hit != "").alias("hit"))

        return F.filter(F.transform(F.try_element_at(by_word, F.get(words, i)), of), lambda d: d["hit"])

    return F.when(F.size(words) > 0, F.flatten(F.transform(at, match)))


def unsuppressed(found: Column) -> Column:
    """(end, labels, score) after suppression: in order of start, longest first, then rule order, a detection inside the reach
    of an earlier one is contained in it and goes."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = end <= acc["end"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["score"])).alias("score"),
        )

    return F.aggregate(F.array_sort(found), start, step)


def license_scan(docs: DataFrame, text: str = "text", to: str = "licenses") -> DataFrame:
    """Adds the struct column `to`: n_words, places (array of struct: start, label) of base phrases, labels, score.

    A-Z are lower-cased and words are runs of other characters than ASCII separators. Only texts that pass the keyword gate
    are looked at by rules, and a rule only at words that it can begin with. Where detections are contained in another, the
    outer one stays, and of equal intervals the rule that comes first. Labels of base phrases always stay.

    A null text is empty. A column of the name `to` is replaced; all others stay, whatever their names. Repeated rows are judged
    alike. Work is linear in a text's words; a very long text is one row in one task.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    firsts = sorted({w for r in rules() for w in r.first.split()})
    own = Carried(docs, to)
    whole = F.coalesce(F.col(own.at(text)), F.lit(""))
    parts = F.col("_parts")
    blank = lambda x: (x == "").cast("int")
    n_words = F.greatest(F.lit(0), F.size(parts) - blank(F.get(parts, F.lit(0))) - blank(F.element_at(parts, -1)))
    own_words = F.filter(F.split(F.translate(whole, upper, upper.lower()), SEPARATOR), lambda w: w != "")
    gate = reduce(or_, (F.col("_low").contains(k) for k in GATE), F.col("_low").contains(GATE_PAIR[0]) & F.col("_low").contains(GATE_PAIR[1]))
    rows = own.rows.withColumn("_parts", F.split(whole, SEPARATOR_BOTH)).withColumn("_n", n_words).withColumn("_low", F.lower(whole)).withColumn("_gate", gate)
    rows = rows.withColumn("_words", F.when(F.col("_gate"), own_words).otherwise(F.array().cast("array<string>")))
    words = F.col("_words")
    spots = F.flatten(F.array(*(labelled(places(words, p), label) for p, label in BASE_PHRASES.items())))
    none = F.array().cast("array<struct<start:int,label:string>>")
    rows = rows.withColumn("_base", F.when(F.col("_gate"), spots).otherwise(none))
    kept = F.when(F.col("_gate"), unsuppressed(detections(words, rules_by_word(), firsts)))
    rows = rows.withColumn("_kept", kept)
    base = F.array_sort(F.array_distinct(F.transform("_base", lambda p: p["label"])))
    labels = F.coalesce(F.col("_kept.labels"), F.array().cast("array<string>"))
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_kept.score", F.lit(0.0)))
    result = F.struct(F.col("_n").cast("long").alias("n_words"), F.col("_base").alias("places"), base.alias("base_labels"), F.array_sort(F.array_union(base, labels)).alias("labels"), score.alias("score"))
    return rows.select(*own.back(), result.alias(to))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules for a reader."""
    return spark.createDataFrame([(r.order, r.label, r.first, r.pattern, r.score) for r in rules()], "rule_order int, label string, first_words string, pattern string, score double")
