"""Signatures of licenses, written by hand over normalised words.

A pattern is matched against a text's words (A-Z lower-cased, letters and digits kept, all else a
space), so `GPL-3.0-or-later` reads `gpl 3 0 or later` and `apache.org/licenses` reads `apache org licenses`.
It covers whole words and uses only what Java's and RE2's expressions have in common.

Priorities: 1 tags and addresses, 2 grants and the wording of a license, 3 names, 4 hints.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    gate: str  #: one of GATES: a text without it is not looked at
    keyword: str  #: what every match contains
    pattern: str


#: A document that has none of these holds no license.
GATES = ("licen", "copyright", "copyleft", "spdx", "rights", "warrant", "permi", "redistrib", "public domain", "cc by", "cc0", "gpl", "creativecommons", "gnu org", "apache org", "mozilla org", "kopimi")

CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6}

#: The phrases that always count, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_L = "licen[cs]e"
_V = "(?:v|version |v )?"

# (label, words of its identifier, gate of the name, keyword of the name, name)
_LICENSES = (
    ("mit", "mit", "licen", "mit licen", f"(?:the )?mit {_L}"),
    ("mit-0", "mit 0", "licen", "mit no attribution", f"mit no attribution {_L}"),
    ("x11", "x11", "licen", "x11 licen", f"(?:the )?x11 {_L}"),
    ("isc", "isc", "licen", "isc licen", f"(?:the )?isc {_L}"),
    ("0bsd", "0bsd", "licen", "bsd", f"(?:0bsd|0 bsd|zero clause bsd|bsd zero clause) {_L}"),
    ("bsd-2-clause", "bsd 2 clause", "licen", "bsd", f"(?:the )?(?:simplified bsd {_L}|freebsd {_L}|bsd 2 clause(?: simplified)? {_L}|2 clause bsd {_L}|two clause bsd {_L})"),
    ("bsd-3-clause", "bsd 3 clause", "licen", "bsd", f"(?:the )?(?:new bsd {_L}|modified bsd {_L}|revised bsd {_L}|bsd 3 clause(?: new or revised)? {_L}|3 clause bsd {_L}|three clause bsd {_L})"),
    ("bsd-4-clause", "bsd 4 clause", "licen", "bsd", f"(?:the )?(?:original bsd {_L}|bsd 4 clause(?: original or old)? {_L}|4 clause bsd {_L}|four clause bsd {_L})"),
    ("bsd-3-clause-clear", "bsd 3 clause clear", "licen", "clear bsd", f"(?:the )?clear bsd {_L}"),
    ("apache-1.1", "apache 1 1", "licen", "apache", f"apache (?:software )?{_L} {_V}1 1"),
    ("apache-2.0", "apache 2 0", "licen", "apache", f"apache (?:software )?{_L} {_V}2(?: 0)?|apache 2(?: 0)? {_L}"),
    ("gpl-1.0", "gpl 1 0(?: only)?", "licen", "general public", f"(?:gnu )?general public {_L} {_V}1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0(?: only)?", "licen", "general public", f"(?:gnu )?general public {_L} (?:gpl )?{_V}2(?: 0)?"),
    ("gpl-2.0-or-later", "gpl 2 0 or later", "licen", "general public", f"(?:gnu )?general public {_L} (?:gpl )?{_V}2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("gpl-3.0", "gpl 3 0(?: only)?", "licen", "general public", f"(?:gnu )?general public {_L} (?:gpl )?{_V}3(?: 0)?"),
    ("gpl-3.0-or-later", "gpl 3 0 or later", "licen", "general public", f"(?:gnu )?general public {_L} (?:gpl )?{_V}3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "licen", "library general public", f"(?:gnu )?library general public {_L} {_V}2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only)?", "licen", "lesser general public", f"(?:gnu )?lesser general public {_L} (?:lgpl )?{_V}2 1"),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later", "licen", "lesser general public", f"(?:gnu )?lesser general public {_L} (?:lgpl )?{_V}2 1 or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("lgpl-3.0", "lgpl 3 0(?: only)?", "licen", "lesser general public", f"(?:gnu )?lesser general public {_L} (?:lgpl )?{_V}3(?: 0)?"),
    ("lgpl-3.0-or-later", "lgpl 3 0 or later", "licen", "lesser general public", f"(?:gnu )?lesser general public {_L} (?:lgpl )?{_V}3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("agpl-3.0", "agpl 3 0(?: only)?", "licen", "affero general public", f"(?:gnu )?affero general public {_L} (?:agpl )?{_V}3(?: 0)?"),
    ("agpl-3.0-or-later", "agpl 3 0 or later", "licen", "affero general public", f"(?:gnu )?affero general public {_L} (?:agpl )?{_V}3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", "licen", "free documentation", f"(?:gnu )?free documentation {_L} {_V}1 2"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "licen", "free documentation", f"(?:gnu )?free documentation {_L} {_V}1 3"),
    ("mpl-1.1", "mpl 1 1", "licen", "mozilla public", f"mozilla public {_L} {_V}1 1"),
    ("mpl-2.0", "mpl 2 0", "licen", "mozilla public", f"mozilla public {_L} {_V}2(?: 0)?"),
    ("epl-1.0", "epl 1 0", "licen", "eclipse public", f"eclipse public {_L} {_V}1(?: 0)?"),
    ("epl-2.0", "epl 2 0", "licen", "eclipse public", f"eclipse public {_L} {_V}2(?: 0)?"),
    ("edl-1.0", "edl 1 0", "licen", "eclipse distribution", f"eclipse distribution {_L} {_V}1(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", "licen", "common development and distribution", f"common development and distribution {_L}(?: cddl)?(?: {_V}1 0)?"),
    ("cddl-1.1", "cddl 1 1", "licen", "common development and distribution", f"common development and distribution {_L}(?: cddl)? {_V}1 1"),
    ("cpl-1.0", "cpl 1 0", "licen", "common public", f"common public {_L} {_V}1(?: 0)?"),
    ("cpal-1.0", "cpal 1 0", "licen", "common public attribution", f"common public attribution {_L}(?: {_V}1 0)?"),
    ("ipl-1.0", "ipl 1 0", "licen", "ibm public", f"ibm public {_L}(?: {_V}1 0)?"),
    ("eupl-1.1", "eupl 1 1", "licen", "european union public", f"european union public {_L} {_V}1 1"),
    ("eupl-1.2", "eupl 1 2", "licen", "european union public", f"european union public {_L} {_V}1 2"),
    ("osl-3.0", "osl 3 0", "licen", "open software licen", f"open software {_L} {_V}3(?: 0)?"),
    ("afl-3.0", "afl 3 0", "licen", "academic free licen", f"academic free {_L} {_V}3(?: 0)?"),
    ("artistic-1.0", "artistic 1 0(?: perl)?", "licen", "artistic licen", f"artistic {_L} {_V}1(?: 0)?"),
    ("artistic-2.0", "artistic 2 0", "licen", "artistic licen", f"artistic {_L} {_V}2(?: 0)?"),
    ("bsl-1.0", "bsl 1 0", "licen", "boost software", f"boost software {_L}(?: {_V}1 0)?"),
    ("busl-1.1", "busl 1 1", "licen", "business source", f"business source {_L}(?: {_V}1 1)?"),
    ("zlib", "zlib", "licen", "zlib", f"(?:the )?zlib(?: libpng)? {_L}"),
    ("libpng", "libpng(?: 2 0)?", "licen", "libpng", f"(?:the )?libpng {_L}"),
    ("openssl", "openssl", "licen", "openssl", f"(?:the )?openssl(?: ssleay)? {_L}"),
    ("postgresql", "postgresql", "licen", "postgresql", f"(?:the )?postgresql {_L}"),
    ("python-2.0", "(?:python|psf) 2 0", "licen", "python", f"(?:python software foundation {_L}|python {_L})(?: {_V}2(?: 0)?)?"),
    ("php-3.01", "php 3 01", "licen", "php licen", f"php {_L}(?: {_V}3 01)?"),
    ("ruby", "ruby", "licen", "ruby", f"(?:the )?ruby {_L}"),
    ("unicode-dfs-2016", "unicode dfs 2016", "licen", "unicode", f"unicode {_L} agreement(?: data files and software)?"),
    ("w3c", "w3c", "licen", "w3c", f"w3c software(?: notice)?(?: and)?(?: document)? {_L}"),
    ("ofl-1.1", "ofl 1 1", "licen", "open font", f"(?:sil )?open font {_L}(?: {_V}1 1)?"),
    ("unlicense", "unlicense", "licen", "unlicen", f"(?:the )?un{_L}"),
    ("wtfpl", "wtfpl", "licen", "public licen", f"do what the f[^ ]* you want to public {_L}"),
    ("ms-pl", "ms pl", "licen", "microsoft public", f"microsoft public {_L}(?: ms pl)?"),
    ("ms-rl", "ms rl", "licen", "microsoft reciprocal", f"microsoft reciprocal {_L}(?: ms rl)?"),
    ("odbl-1.0", "odbl 1 0", "licen", "open database", f"(?:odc )?open (?:data commons open )?database {_L}(?: {_V}1 0)?"),
    ("pddl-1.0", "pddl 1 0", "licen", "public domain dedication", f"(?:odc )?public domain dedication and {_L}(?: {_V}1 0)?"),
    ("odc-by-1.0", "odc by 1 0", "licen", "open data commons attribution", f"open data commons attribution {_L}(?: {_V}1 0)?"),
    ("ecl-2.0", "ecl 2 0", "licen", "educational community", f"educational community {_L}(?: {_V}2 0)?"),
    ("ncsa", "ncsa", "licen", "ncsa", f"(?:university of illinois )?(?:illinois )?ncsa open source {_L}"),
    ("upl-1.0", "upl 1 0", "licen", "universal permissive", f"universal permissive {_L}(?: upl)?(?: {_V}1 0)?"),
    ("qpl-1.0", "qpl 1 0", "licen", "q public", f"q public {_L}(?: {_V}1 0)?"),
    ("sspl-1.0", "sspl 1 0", "licen", "server side public", f"server side public {_L}(?: {_V}1(?: 0)?)?"),
    ("cc0-1.0", "cc0 1 0", "cc0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc-by-2.0", "cc by 2 0", "cc by", "cc by", f"(?:creative commons )?cc by {_V}2 0(?: generic)?"),
    ("cc-by-3.0", "cc by 3 0", "cc by", "cc by", f"(?:creative commons )?cc by {_V}3 0(?: unported)?"),
    ("cc-by-4.0", "cc by 4 0", "cc by", "cc by", f"(?:creative commons )?cc by {_V}4 0(?: international)?"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "cc by", "cc by sa", f"(?:creative commons )?cc by sa {_V}3 0(?: unported)?"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc by", "cc by sa", f"(?:creative commons )?cc by sa {_V}4 0(?: international)?"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "cc by", "cc by nc", f"(?:creative commons )?cc by nc {_V}3 0(?: unported)?"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc by", "cc by nc", f"(?:creative commons )?cc by nc {_V}4 0(?: international)?"),
    ("cc-by-nd-3.0", "cc by nd 3 0", "cc by", "cc by nd", f"(?:creative commons )?cc by nd {_V}3 0(?: unported)?"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "cc by", "cc by nd", f"(?:creative commons )?cc by nd {_V}4 0(?: international)?"),
    ("cc-by-nc-sa-3.0", "cc by nc sa 3 0", "cc by", "cc by nc sa", f"(?:creative commons )?cc by nc sa {_V}3 0(?: unported)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc by", "cc by nc sa", f"(?:creative commons )?cc by nc sa {_V}4 0(?: international)?"),
    ("cc-by-nc-nd-3.0", "cc by nc nd 3 0", "cc by", "cc by nc nd", f"(?:creative commons )?cc by nc nd {_V}3 0(?: unported)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "cc by", "cc by nc nd", f"(?:creative commons )?cc by nc nd {_V}4 0(?: international)?"),
)

_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|shared|redistributed) (?:by|under|subject to|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

# (label, gate, keyword, address or tag)
_ADDRESSES = (
    ("apache-2.0", "apache org", "apache org licenses", "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache org", "apache org licenses", "(?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?"),
    ("gpl-2.0", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html| en html)?"),
    ("gpl-3.0", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses gpl 3 0(?: txt| html| en html)?"),
    ("gpl", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses(?: gpl(?: txt| html| en html)?)?"),
    ("lgpl-2.1", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html| en html)?"),
    ("lgpl-3.0", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: txt| html| en html)?"),
    ("agpl-3.0", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses agpl 3 0(?: txt| html| en html)?"),
    ("gfdl-1.3", "gnu org", "licenses", "(?:https? )?(?:www )?gnu org licenses fdl 1 3(?: txt| html| en html)?"),
    ("mpl-2.0", "mozilla org", "mpl 2 0", "(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", "mpl", "(?:https? )?(?:www )?mozilla org mpl(?: mpl)? 1 1(?: txt| html)?"),
    ("mit", "licen", "opensource org licenses mit", "(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?"),
    ("bsd-2-clause", "licen", "opensource org licenses bsd 2", "(?:https? )?(?:www )?opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "licen", "opensource org licenses bsd 3", "(?:https? )?(?:www )?opensource org licenses bsd 3 clause"),
    ("isc", "licen", "opensource org licenses isc", "(?:https? )?(?:www )?opensource org licenses isc"),
    ("apache-2.0", "licen", "opensource org licenses apache", "(?:https? )?(?:www )?opensource org licenses apache 2 0"),
    ("artistic-2.0", "licen", "opensource org licenses artistic", "(?:https? )?(?:www )?opensource org licenses artistic license 2 0"),
    ("epl-1.0", "licen", "eclipse org legal", "(?:https? )?(?:www )?eclipse org legal epl v10(?: html)? licen[cs]e|licen[cs]e (?:at )?(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "licen", "eclipse org legal", "(?:https? )?(?:www )?eclipse org legal epl 2 0 licen[cs]e|licen[cs]e (?:at )?(?:https? )?(?:www )?eclipse org legal epl 2 0"),
    ("bsl-1.0", "licen", "boost org", "(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
    ("unlicense", "licen", "unlicense org", "(?:https? )?(?:www )?unlicense org"),
    ("ofl-1.1", "licen", "openfontlicense org", "(?:https? )?(?:www )?openfontlicense org"),
    ("odbl-1.0", "licen", "opendatacommons org licenses odbl", "(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("pddl-1.0", "licen", "opendatacommons org licenses pddl", "(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("odc-by-1.0", "licen", "opendatacommons org licenses by", "(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero", "(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark", "(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0"),
    ("cc-by-2.0", "creativecommons", "creativecommons org licenses by 2 0", "(?:https? )?(?:www )?creativecommons org licenses by 2 0"),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0", "(?:https? )?(?:www )?creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0", "(?:https? )?(?:www )?creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa", "(?:https? )?(?:www )?creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa", "(?:https? )?(?:www )?creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-3.0", "creativecommons", "creativecommons org licenses by nc", "(?:https? )?(?:www )?creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc", "(?:https? )?(?:www )?creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd", "(?:https? )?(?:www )?creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa", "(?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd", "(?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0"),
)

# (label, gate, keyword, wording)
_WORDINGS = (
    ("mit", "permi", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "copyright", "copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies(?: or substantial portions of the software)?"),
    ("mit-0", "permi", "without restriction including without limitation the rights", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permi", "permission to use copy modify and", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permi", "permission to use copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("hpnd", "permi", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "redistrib", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd-3-clause", "permi", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "rights", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledg[^ ]* (?:[^ ]+ ){0,24}rights"),
    ("bsd", "redistrib", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistrib", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2.0", "licen", "you may not use this file except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "licen", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "redistrib", "is free software you can redistribute it", "this (?:program|library|file|package|work) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "warrant", "this program is distributed in the hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0-or-later", "licen", "either version 2", "general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "licen", "either version 3", "general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "licen", "version 2 of the license", "general public license as published by the free software foundation version 2 of the license"),
    ("lgpl", "redistrib", "gnu lesser general public", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl", "redistrib", "gnu library general public", "you can redistribute it and or modify it under the terms of the gnu library general public licen[cs]e"),
    ("agpl", "redistrib", "gnu affero general public", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "gpl", "licensed under the gpl", "(?:dual )?licensed under the gpl(?: v?[123](?: 0)?)?"),
    ("gpl-2.0", "gpl", "gpl", "(?:gnu )?(?:gplv2|gpl v2|gpl 2 0|gpl version 2)"),
    ("gpl-3.0", "gpl", "gpl", "(?:gnu )?(?:gplv3|gpl v3|gpl 3 0|gpl version 3)"),
    ("lgpl-2.1", "gpl", "lgpl", "(?:gnu )?(?:lgplv2 1|lgpl v2 1|lgpl 2 1|lgpl version 2 1)"),
    ("lgpl-3.0", "gpl", "lgpl", "(?:gnu )?(?:lgplv3|lgpl v3|lgpl 3 0|lgpl version 3)"),
    ("agpl-3.0", "gpl", "agpl", "(?:gnu )?(?:agplv3|agpl v3|agpl 3 0|agpl version 3)"),
    ("mpl-2.0", "licen", "this source code form is subject to", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "licen", "mozilla public", "if a copy of the mpl was not distributed with this file you can obtain one at (?:[^ ]+ ){0,8}mozilla public licen[cs]e"),
    ("cddl-1.0", "licen", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("mpl-1.1", "licen", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "licen", "eclipse public license v1 0", "(?:this program and the )?accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "licen", "eclipse public license", "(?:this program and the )?accompanying materials are made available under the terms of the eclipse public license (?:v|v )?2 0"),
    ("zlib", "permi", "permission is granted to anyone to use this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1.0", "permi", "permission is hereby granted free of charge to any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ofl-1.1", "licen", "open font license", "this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("unlicense", "public domain", "free and unencumbered software released", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "permi", "everyone is permitted to copy and distribute verbatim or modified copies", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("gpl", "permi", "everyone is permitted to copy and distribute verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("beerware", "licen", "beer ware licen", "(?:the )?beer ware licen[cs]e"),
    ("public-domain", "public domain", "public domain", "(?:released|placed|put|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain", "(?:is|are) (?:now )?(?:hereby )?in the public domain"),
    ("public-domain", "public domain", "no rights reserved", "no rights reserved (?:[^ ]+ ){0,6}public domain"),
    ("cc-by", "licen", "creative commons attribution", f"creative commons attribution(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("cc-by-sa", "licen", "creative commons attribution", f"creative commons attribution (?:sharealike|share alike)(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("cc-by-nc", "licen", "creative commons attribution", f"creative commons attribution (?:noncommercial|non commercial)(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("cc-by-nd", "licen", "creative commons attribution", f"creative commons attribution (?:noderivs|noderivatives|no derivs|no derivatives|no derivative works)(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("cc-by-nc-sa", "licen", "creative commons attribution", f"creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("cc-by-nc-nd", "licen", "creative commons attribution", f"creative commons attribution (?:noncommercial|non commercial) (?:noderivs|noderivatives|no derivs|no derivatives|no derivative works)(?: {_V}[1-4] [05])?(?: generic| unported| international)?(?: public)? {_L}"),
    ("kopimi", "kopimi", "kopimi", "(?:this work is )?(?:kopimi|kopimied)"),
    ("proprietary", "permi", "without the express written permission", "may not be (?:copied|reproduced|distributed|used|published)(?: [^ ]+){0,12} without the express written permission"),
    ("proprietary", "permi", "without prior written permission", "may not be (?:copied|reproduced|distributed|used|published)(?: [^ ]+){0,12} without prior written permission"),
    ("proprietary", "copyright", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: [^ ]+){0,12} (?:copyright|copyrighted)(?: material| work| owner| law)?"),
    ("proprietary", "licen", "proprietary", "proprietary (?:software )?licen[cs]e(?: agreement)?"),
    ("proprietary", "licen", "commercial", "commercial (?:software )?licen[cs]e(?: agreement)?"),
    ("mit", "licen", "expat", f"(?:the )?(?:mit )?expat {_L}"),
    ("proprietary", "licen", "end user licen", "end user licen[cs]e agreement"),
)

# (label, gate, keyword, name or hint without a version)
_HINTS = (
    ("apache", "licen", "apache", f"(?:the )?apache (?:software )?{_L}"),
    ("bsd", "licen", "bsd", f"(?:the )?bsd(?: style)? {_L}"),
    ("gpl", "gpl", "gnu gpl", "(?:the )?gnu gpl"),
    ("lgpl", "licen", "lesser general public", f"(?:the )?(?:gnu )?lesser general public {_L}"),
    ("lgpl", "gpl", "gnu lgpl", "(?:the )?gnu lgpl"),
    ("agpl", "licen", "affero general public", f"(?:the )?(?:gnu )?affero general public {_L}"),
    ("agpl", "gpl", "gnu agpl", "(?:the )?gnu agpl"),
    ("gfdl", "licen", "free documentation", f"(?:the )?(?:gnu )?free documentation {_L}"),
    ("mpl", "licen", "mozilla public", f"(?:the )?mozilla public {_L}"),
    ("epl", "licen", "eclipse public", f"(?:the )?eclipse public {_L}"),
    ("eupl", "licen", "european union public", f"(?:the )?european union public {_L}"),
    ("artistic", "licen", "artistic", f"(?:the )?artistic {_L}"),
    ("mit", "licen", "mit style", f"mit style {_L}"),
    ("cc-by-sa", "cc by", "cc by sa", "cc by sa"),
    ("cc-by-nc", "cc by", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by", "cc by nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd", "cc by nc nd"),
    ("creative-commons", "licen", "creative commons", f"(?:a )?creative commons (?:public )?{_L}"),
    ("copyleft", "copyleft", "copyleft", "copyleft"),
    ("some-rights", "rights", "some rights reserved", "some rights reserved"),
    ("copyright", "copyright", "copyright", "copyright (?:c )?(?:by )?(?:1[89]|20)[0-9][0-9](?: (?:1[89]|20)[0-9][0-9])?"),
    ("no-warranty", "warrant", "without warranty of any kind", "without warranty of any kind(?: express or implied)?"),
    ("no-warranty", "warrant", "without any warranty", "without any warranty"),
    ("no-warranty", "warrant", "merchantability", "warrant(?:y|ies) of merchantability(?: and| or)?(?: fitness for a particular purpose)?"),
    ("source-available", "licen", "source available", f"source available {_L}"),
    ("permissive", "licen", "permissive", f"permissive(?: free)?(?: software)? {_L}"),
    ("royalty-free", "licen", "royalty free", f"royalty free(?: [^ ]+){{0,6}} {_L}"),
)


def _all_rules() -> tuple[Rule, ...]:
    out = []
    for label, identifier, gate, keyword, name in _LICENSES:
        out.append((label, 1, "spdx", "spdx license identifier", f"spdx license identifier (?:{identifier})"))
        out.append((label, 2, gate, keyword, f"{_GRANT}(?:{name})"))
        out.append((label, 3, gate, keyword, f"(?:{name})"))
    out += [(label, 1, gate, keyword, f"(?:{pattern})") for label, gate, keyword, pattern in _ADDRESSES]
    out += [(label, 2, gate, keyword, f"(?:{pattern})") for label, gate, keyword, pattern in _WORDINGS]
    out += [(label, 4, gate, keyword, f"(?:{pattern})") for label, gate, keyword, pattern in _HINTS]
    return tuple(Rule(i, *r) for i, r in enumerate(out))


RULES = _all_rules()


def spaced(pattern: str) -> str:
    """A keyword over words that stand two spaces apart, so that neighbouring matches share none."""
    return pattern.replace(" ", "  ")


def whole_words(pattern: str) -> str:
    """A pattern over such words, with the space on either side of the match. Classes keep their one space."""
    return " " + spaced(pattern).replace("[^  ]", "[^ ]") + " "
