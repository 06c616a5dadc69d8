"""Signatures of licenses, each written by hand, for operator 7.

A signature is a row of words as they stand in a text whose letters are lower-cased and whose other
signs, line breaks and comment marks are gone. Each word is a regex; one with ? in front may be absent,
..n stands for up to n words of any kind, and "license" and its forms also match the spelling with c.

Priorities: 1 names one license for certain (its own text, an identifier, its address, a grant), 2 names
it in passing or without a version, 3 only suggests it.
"""

from __future__ import annotations

import re

#: (label, priority, signature).
SIGNATURES = [
    # MIT and its kin
    ("mit", 1, "spdx license identifier mit"),
    ("mit", 1, "(?:licensed|released|distributed|available|provided|published) under ?the ?terms ?of ?the mit ?license"),
    ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 1, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 1, "opensource org licenses mit"),
    ("mit", 1, "license mit"),
    ("mit", 2, "mit ?style license"),
    ("mit", 2, "mit licensed"),
    ("mit", 2, "expat license"),
    ("mit-0", 1, "spdx license identifier mit 0"),
    ("mit-0", 1, "mit no attribution ?license"),
    ("x11", 1, "x11 license"),
    ("x11", 2, "x consortium ..6 not be used in advertising"),
    ("mit-cmu", 1, "cmu license"),
    ("mit-modern", 1, "mit modern variant"),
    # Apache
    ("apache-2.0", 1, "spdx license identifier apache 2 0"),
    ("apache-2.0", 1, "licensed under the apache license version 2 0"),
    ("apache-2.0", 1, "(?:released|distributed|available|provided|published) under ?the ?terms ?of ?the apache ?software ?license ?version (?:v2|2) ?0"),
    ("apache-2.0", 1, "apache org licenses license 2 0"),
    ("apache-2.0", 1, "apache license ?version (?:v2|2) ?0"),
    ("apache-2.0", 1, "opensource org licenses apache 2 0"),
    ("apache-2.0", 2, "license apache ?v v?2 0"),
    ("apache-2.0", 2, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 2, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-1.1", 1, "spdx license identifier apache 1 1"),
    ("apache-1.1", 1, "apache ?software license ?version 1 1"),
    ("apache-1.0", 1, "apache ?software license ?version 1 0"),
    ("apache", 2, "apache software license"),
    ("apache", 2, "apache licensed"),
    ("apache", 3, "this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl-2.0", 1, "spdx license identifier gpl 2 0 ?only"),
    ("gpl-2.0-or-later", 1, "spdx license identifier gpl 2 0 or later"),
    ("gpl-3.0", 1, "spdx license identifier gpl 3 0 ?only"),
    ("gpl-3.0-or-later", 1, "spdx license identifier gpl 3 0 or later"),
    ("gpl-2.0", 1, "gnu general public license version 2"),
    ("gpl-3.0", 1, "gnu general public license version 3"),
    ("gpl-2.0", 1, "gnu general public license v2"),
    ("gpl-3.0", 1, "gnu general public license v3"),
    ("gpl-2.0-or-later", 1, "either version 2 of the license or ?at ?your ?option any later version"),
    ("gpl-3.0-or-later", 1, "either version 3 of the license or ?at ?your ?option any later version"),
    ("gpl", 1, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 2, "you should have received a copy of the gnu general public license"),
    ("gpl", 2, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu gpl"),
    ("gpl-2.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu (?:gplv2|gpl2)"),
    ("gpl-3.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu (?:gplv3|gpl3)"),
    ("gpl-2.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu gpl ?version ?v v?2 ?0"),
    ("gpl-3.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu gpl ?version ?v v?3 ?0"),
    ("gpl-2.0", 1, "license gplv2"),
    ("gpl-3.0", 1, "license gplv3"),
    ("gpl-2.0", 2, "gpl 2 0 ?only"),
    ("gpl-3.0", 2, "gpl 3 0 ?only"),
    ("gpl-2.0-or-later", 2, "gpl 2 0 or later"),
    ("gpl-3.0-or-later", 2, "gpl 3 0 or later"),
    ("gpl-3.0", 1, "gnu org licenses gpl 3 0"),
    ("gpl-2.0", 1, "gnu org licenses old licenses gpl 2 0"),
    ("gpl", 2, "gnu org licenses gpl"),
    ("gpl", 2, "gnu gpl"),
    ("gpl", 2, "gnu public license"),
    ("gpl", 2, "gpl license"),
    ("gpl", 3, "gpl compatible"),
    ("gpl", 3, "gpl or later"),
    ("gpl", 3, "free software foundation ..8 general public license"),
    ("gpl-with-classpath", 1, "classpath exception"),
    ("gpl-with-gcc", 1, "gcc runtime library exception"),
    ("lgpl-2.0", 1, "spdx license identifier lgpl 2 0 ?only"),
    ("lgpl-2.1", 1, "spdx license identifier lgpl 2 1 ?only"),
    ("lgpl-2.1-or-later", 1, "spdx license identifier lgpl 2 1 or later"),
    ("lgpl-3.0", 1, "spdx license identifier lgpl 3 0 ?only"),
    ("lgpl-3.0-or-later", 1, "spdx license identifier lgpl 3 0 or later"),
    ("lgpl-2.1", 1, "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", 1, "gnu lesser general public license version 3"),
    ("lgpl-2.0", 1, "gnu library general public license ?version ?2"),
    ("lgpl", 2, "gnu lesser general public license"),
    ("lgpl-2.1", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu lgpl ?version ?v v?2 1"),
    ("lgpl-3.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu (?:lgplv3|lgpl3)"),
    ("lgpl", 2, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu lgpl"),
    ("lgpl", 2, "gnu org licenses lgpl"),
    ("lgpl", 2, "lgpl license"),
    ("agpl-3.0", 1, "spdx license identifier agpl 3 0 ?only"),
    ("agpl-3.0-or-later", 1, "spdx license identifier agpl 3 0 or later"),
    ("agpl-3.0", 1, "gnu affero general public license version 3"),
    ("agpl", 2, "gnu affero general public license"),
    ("agpl", 2, "affero general public license"),
    ("agpl-3.0", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu (?:agplv3|agpl3)"),
    ("agpl", 2, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?gnu agpl"),
    ("agpl", 2, "gnu org licenses agpl"),
    ("gfdl", 1, "gnu free documentation license"),
    ("gfdl-1.3", 1, "spdx license identifier gfdl 1 3 ?only"),
    ("gfdl", 2, "gnu org licenses fdl"),
    ("gfdl", 3, "with no invariant sections"),
    # BSD
    ("0bsd", 1, "spdx license identifier 0bsd"),
    ("0bsd", 1, "zero clause bsd"),
    ("bsd-1-clause", 1, "spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", 1, "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", 1, "spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", 1, "spdx license identifier bsd 4 clause"),
    ("bsd-2-clause", 1, "bsd 2 clause"),
    ("bsd-2-clause", 1, "(?:2|two) clause bsd"),
    ("bsd-3-clause", 1, "bsd 3 clause"),
    ("bsd-3-clause", 1, "(?:3|three) clause bsd"),
    ("bsd-4-clause", 1, "(?:4|four) clause bsd"),
    ("bsd-2-clause", 1, "simplified bsd"),
    ("bsd-2-clause", 1, "freebsd license"),
    ("bsd-3-clause", 1, "(?:new|modified|revised) bsd"),
    ("bsd-4-clause", 1, "(?:original|old) bsd license"),
    ("bsd-4-clause", 1, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", 1, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "redistribution and use in source and binary forms"),
    ("bsd", 2, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 1, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", 1, "no express or implied licenses to any party s patent rights are granted"),
    ("bsd", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the ?a bsd ?style license"),
    ("bsd", 2, "bsd ?style license"),
    ("bsd", 2, "bsd licensed"),
    ("bsd-3-clause", 1, "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 1, "opensource org licenses bsd 2 clause"),
    # short permissive texts
    ("isc", 1, "spdx license identifier isc"),
    ("isc", 1, "permission to use copy modify and ?or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 1, "(?:licensed|released|distributed|available|published) under ?the ?terms ?of ?the isc"),
    ("isc", 2, "isc license"),
    ("isc", 1, "opensource org licenses isc"),
    ("zlib", 1, "spdx license identifier zlib"),
    ("zlib", 1, "this software is provided as is without any express or implied warranty"),
    ("zlib", 1, "altered source versions must be plainly marked as such"),
    ("zlib", 2, "zlib ?libpng license"),
    ("libpng", 1, "libpng license"),
    ("boost-1.0", 1, "spdx license identifier bsl 1 0"),
    ("boost-1.0", 1, "boost software license ?version 1 0"),
    ("boost-1.0", 1, "boost org license 1 0"),
    ("boost", 2, "boost software license"),
    ("boost", 2, "boost license"),
    ("unlicense", 1, "spdx license identifier unlicense"),
    ("unlicense", 1, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, "unlicense org"),
    ("unlicense", 2, "the unlicense"),
    ("wtfpl", 1, "spdx license identifier wtfpl"),
    ("wtfpl", 1, "do what the fuck you want to"),
    ("wtfpl", 2, "wtfpl"),
    ("beerware", 1, "beer ware license"),
    ("beerware", 1, "buy me a beer in return"),
    ("fsf-all-permissive", 1, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("curl", 1, "curl license"),
    ("ntp", 1, "spdx license identifier ntp"),
    ("postgresql", 1, "spdx license identifier postgresql"),
    ("postgresql", 1, "postgresql license"),
    ("ncsa", 1, "spdx license identifier ncsa"),
    ("ncsa", 1, "university of illinois ?ncsa ?open ?source license"),
    ("upl-1.0", 1, "universal permissive license"),
    ("afl-3.0", 1, "academic free license ?version 3 0"),
    ("afl", 2, "academic free license"),
    ("blueoak-1.0.0", 1, "blue oak model license"),
    ("mulan-2.0", 1, "mulan ?permissive ?software license"),
    ("vim", 1, "vim license"),
    ("tcl", 1, "tcl tk license"),
    ("unicode", 1, "unicode ?inc license agreement"),
    ("w3c", 1, "w3c software ?and ?document ?notice ?and license"),
    ("hpnd", 1, "historical permission notice and disclaimer"),
    ("ftl", 1, "freetype ?project license"),
    ("ijg", 1, "independent jpeg group"),
    ("json", 1, "the software shall be used for good not evil"),
    # weak copyleft
    ("mpl-2.0", 1, "spdx license identifier mpl 2 0"),
    ("mpl-1.1", 1, "spdx license identifier mpl 1 1"),
    ("mpl-2.0", 1, "mozilla public license ?version ?v v?2 ?0"),
    ("mpl-1.1", 1, "mozilla public license ?version ?v v?1 1"),
    ("mpl-2.0", 1, "mozilla org mpl 2 0"),
    ("mpl-1.1", 1, "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", 1, "subject to the terms of the mozilla public license"),
    ("mpl", 2, "mozilla public license"),
    ("mpl-2.0", 2, "mpl 2 0"),
    ("epl-1.0", 1, "spdx license identifier epl 1 0"),
    ("epl-2.0", 1, "spdx license identifier epl 2 0"),
    ("epl-1.0", 1, "eclipse public license ?version ?v v?1 0"),
    ("epl-2.0", 1, "eclipse public license ?version ?v v?2 0"),
    ("epl-1.0", 1, "eclipse org legal epl v10"),
    ("epl-2.0", 1, "eclipse org legal epl 2 0"),
    ("epl", 2, "eclipse public license"),
    ("edl", 1, "eclipse distribution license"),
    ("cddl-1.0", 1, "spdx license identifier cddl 1 0"),
    ("cddl", 1, "common development and distribution license"),
    ("cddl", 2, "cddl ?version ?v v?1 [01]"),
    ("cpl-1.0", 1, "common public license"),
    ("ipl", 1, "ibm public license"),
    ("cpal", 1, "common public attribution license"),
    ("eupl", 1, "european union public license"),
    ("eupl-1.2", 1, "eupl ?version ?v v?1 2"),
    ("eupl-1.1", 1, "eupl ?version ?v v?1 1"),
    ("osl-3.0", 1, "open software license ?version ?v v?3 0"),
    ("osl", 2, "open software license"),
    ("ms-pl", 1, "microsoft public license"),
    ("ms-rl", 1, "microsoft reciprocal license"),
    ("artistic-2.0", 1, "spdx license identifier artistic 2 0"),
    ("artistic-2.0", 1, "artistic license ?version 2 0"),
    ("artistic", 2, "artistic license"),
    ("perl", 1, "under the same terms as perl ?itself"),
    ("ruby", 1, "under the same terms as ruby"),
    ("ruby", 1, "spdx license identifier ruby"),
    ("php-3.01", 1, "php license ?version ?v v?3 (?:01|0)"),
    ("psf-2.0", 1, "python software foundation license"),
    ("psf-2.0", 1, "psf license agreement"),
    ("zpl", 1, "zope public license"),
    ("openssl", 1, "openssl license"),
    ("openssl", 1, "this product includes software developed by the openssl project"),
    ("sissl", 1, "sun industry standards source license"),
    ("qpl", 1, "q public license"),
    ("npl", 1, "netscape public license"),
    ("apsl", 1, "apple public source license"),
    ("cecill", 1, "cecill ?free ?software license"),
    ("lppl", 1, "project public license ..6 latex"),
    ("lppl", 1, "latex project public license"),
    # content, data, fonts, models
    ("cc0-1.0", 1, "spdx license identifier cc0 1 0"),
    ("cc0-1.0", 1, "creativecommons org publicdomain zero 1 0"),
    ("cc0", 1, "cc0 ?1 ?0 universal"),
    ("cc0", 2, "cc0"),
    ("cc-by", 1, "creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", 1, "creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nc", 1, "creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nd", 1, "creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc-sa", 1, "creativecommons org licenses by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", 1, "creativecommons org licenses by nc nd [1-4] [0-9]"),
    ("cc-by", 2, "cc by [1-4] [0-9]"),
    ("cc-by-sa", 2, "cc by sa [1-4] [0-9]"),
    ("cc-by-nc", 2, "cc by nc [1-4] [0-9]"),
    ("cc-by-nd", 2, "cc by nd [1-4] [0-9]"),
    ("cc-by-nc-sa", 2, "cc by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", 2, "cc by nc nd [1-4] [0-9]"),
    ("cc-by", 2, "creative commons attribution ?[1-4] ?[0-9] ?international license"),
    ("cc-by-sa", 2, "creative commons attribution share ?alike"),
    ("cc-by-sa", 2, "creative commons attribution sharealike"),
    ("cc-by-nc", 2, "creative commons attribution non ?commercial"),
    ("cc-by-nc", 2, "creative commons attribution noncommercial"),
    ("cc-by-nd", 2, "creative commons attribution no ?derivatives"),
    ("cc-by-nd", 2, "creative commons attribution noderivatives"),
    ("cc", 3, "creative commons license"),
    ("odbl", 1, "open ?data ?commons ?open database license"),
    ("odc-by", 1, "open data commons attribution license"),
    ("pddl", 1, "public domain dedication and license"),
    ("ofl-1.1", 1, "sil open font license"),
    ("ofl-1.1", 1, "spdx license identifier ofl 1 1"),
    ("ofl-1.1", 2, "open font license"),
    ("openrail", 1, "openrail ?m license"),
    ("rail", 1, "responsible ai license"),
    ("llama", 1, "llama ?[1-4] community license"),
    ("public-domain", 2, "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", 3, "in the public domain"),
    # source available and proprietary
    ("bsl-1.1", 1, "business source license"),
    ("bsl-1.1", 1, "spdx license identifier busl 1 1"),
    ("sspl-1.0", 1, "server side public license"),
    ("elastic-2.0", 1, "elastic license ?version ?2 ?0"),
    ("commons-clause", 1, "commons clause ?license ?condition"),
    ("polyform", 1, "polyform (?:noncommercial|shield|perimeter|strict|small) ?business ?license"),
    ("confluent", 1, "confluent community license"),
    ("proprietary", 3, "copyright ..12 all rights reserved"),
    ("proprietary", 2, "proprietary and confidential"),
    ("proprietary", 2, "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)"),
    ("proprietary", 3, "end user license agreement"),
]
#: Words that say little about a license: a rule is gated by a rarer one where it has any.
COMMON = set("license licensed licenses licensing under the public software and or of to version free this is source code open any a in not be by with use used for all general project community".split())
SPELLINGS = re.compile(r"\blicens(e[sd]?|ing)\b")


def _is_plain(word: str) -> bool:
    return re.fullmatch(r"[0-9a-z]+", word) is not None and not SPELLINGS.search(word)


def keyword_of(signature: str) -> str:
    """The longest word that every match has, of those that are not COMMON if there are any."""
    plain = [w for w in signature.split() if _is_plain(w)]
    return max([w for w in plain if w not in COMMON] or plain, key=len)


def regex_of(signature: str) -> str:
    """A regex over words that each stand between two blanks of their own."""
    out = []
    for word in signature.split():
        optional = word[0] == "?"
        body = SPELLINGS.sub(r"licen[cs]\1", word.removeprefix("?"))
        if gap := re.fullmatch(r"\.\.(\d+)", word):
            out.append(rf"(?: [^ ]+ ){{0,{gap[1]}}}")
        else:
            out.append(f"(?: (?:{body}) )?" if optional else f" (?:{body}) ")
    return "".join(out)


#: (label, keyword, priority, regex).
RULES = [(label, keyword_of(signature), priority, regex_of(signature)) for label, priority, signature in SIGNATURES]
