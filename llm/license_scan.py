"""License scans by sentence rules (operator 7), in DataFrame functions alone.

A text is split into sentences; each is normalised (A-Z lower-cased, runs of other
characters than letters and digits become one blank) and looked up among known
licence sentences. The identifiers found, in order, form the text's sequence.
Ordered rules, the most specific first, then match runs of that sequence; what a
rule matches is taken out, so that later rules see the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.batches import ids_and_texts

# Licence sentences as their licences and common notices word them, normalised. Notices that hold a
# sentence end inside a sentence ("free software; you can", "v. 2.0", a blank line before an address) are listed by
# the parts that splitting leaves, too. "2 0" and the address behind "at" tell nothing alone and are left out.
SENTENCES: list[tuple[str, str]] = [
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIsMit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("LiableMit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("MitTitle", "mit license"),
    ("MitTitle", "the mit license"),
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitRef", "this project is licensed under the mit license"),
    ("MitRef", "distributed under the mit license"),
    ("MitRef", "spdx license identifier mit"),
    ("ApacheTitle", "apache license version 2 0"),
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "licensed under the apache license version 2 0 the license"),
    ("ApacheRef", "released under the apache license version 2 0"),
    ("ApacheRef", "spdx license identifier apache 2 0"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheObtain", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("ApacheObtain", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AsIsBsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("Bsd2Ref", "spdx license identifier bsd 2 clause"),
    ("Bsd3Ref", "spdx license identifier bsd 3 clause"),
    ("Bsd3Ref", "licensed under the bsd 3 clause license"),
    ("GplFree3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplProgram", "this program is free software"),
    ("GplTerms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("GplProgramTerms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("GplEither3", "either version 3 of the license or at your option any later version"),
    ("GplEither2", "either version 2 of the license or at your option any later version"),
    ("GplTermsEither3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplTermsEither2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplUseful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("GplWithout", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu general public license for more details"),
    ("Gpl3Ref", "this work is licensed under the gnu general public license version 3"),
    ("Gpl3Ref", "licensed under the gnu general public license version 3"),
    ("Gpl3Ref", "spdx license identifier gpl 3 0 only"),
    ("Gpl3LaterRef", "spdx license identifier gpl 3 0 or later"),
    ("Gpl2Ref", "licensed under the gnu general public license version 2"),
    ("Gpl2Ref", "spdx license identifier gpl 2 0 only"),
    ("LgplRef", "licensed under the gnu lesser general public license version 3"),
    ("MplForm", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplForm", "this source code form is subject to the terms of the mozilla public license v"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("AsIsIsc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("CcByRef", "licensed under cc by 4 0"),
    ("CcByRef", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CcBySaRef", "licensed under cc by sa 4 0"),
    ("CcByNcRef", "licensed under cc by nc 4 0"),
    ("CcByNcRef", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("Apache2Grant", "grant of copyright license"),
    ("ApacheCopyGrant", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("ApacheTerms", "terms and conditions for use reproduction and distribution"),
    ("ApacheRef", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("ApacheRef", "this project is licensed under the apache license version 2 0"),
    ("ApacheRef", "licensed under the apache 2 0 license"),
    ("ApacheRef", "license apache 2 0"),
    ("ApacheRef", "apache license 2 0"),
    ("MitRef", "license mit"),
    ("MitRef", "this software is released under the mit license"),
    ("MitRef", "this software is licensed under the mit license"),
    ("MitRef", "this code is released under the mit license"),
    ("MitRef", "this code is licensed under the mit license"),
    ("MitRef", "available under the mit license"),
    ("MitRef", "use of this source code is governed by an mit style license that can be found in the license file"),
    ("AsIsMitHolders", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"),
    ("X11Name", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium"),
    ("BsdStyleRef", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("Bsd3Ref", "this project is licensed under the bsd 3 clause license"),
    ("Bsd3Ref", "released under the bsd 3 clause license"),
    ("Bsd3Ref", "license bsd 3 clause"),
    ("Bsd2Ref", "this project is licensed under the bsd 2 clause license"),
    ("Bsd2Ref", "licensed under the bsd 2 clause license"),
    ("Bsd2Ref", "released under the bsd 2 clause license"),
    ("Bsd2Ref", "license bsd 2 clause"),
    ("BsdTitle", "bsd 3 clause license"),
    ("Bsd2Title", "bsd 2 clause license"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3"),
    ("BsdAd", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BsdEndorse", "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AsIsBsd", "this software is provided by the author and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("AsIsBsd", "this software is provided by the author as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("AsIsBsd", "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("LiableBsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("LgplLibrary", "this library is free software"),
    ("LgplTerms21", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LgplTerms3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LgplTerms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("GplEither21", "either version 2 1 of the license or at your option any later version"),
    ("LgplUseful", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("LgplSee", "see the gnu lesser general public license for more details"),
    ("Lgpl21Ref", "spdx license identifier lgpl 2 1 or later"),
    ("Lgpl21Ref", "spdx license identifier lgpl 2 1 only"),
    ("LgplRef", "spdx license identifier lgpl 3 0 only"),
    ("LgplRef", "spdx license identifier lgpl 3 0 or later"),
    ("AgplTerms", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("AgplTermsEither3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("AgplSee", "see the gnu affero general public license for more details"),
    ("AgplRef", "licensed under the gnu affero general public license version 3"),
    ("AgplRef", "spdx license identifier agpl 3 0 only"),
    ("AgplRef", "spdx license identifier agpl 3 0 or later"),
    ("Gpl3Title", "gnu general public license version 3 29 june 2007"),
    ("Gpl2Title", "gnu general public license version 2 june 1991"),
    ("GplReceived", "you should have received a copy of the gnu general public license along with this program"),
    ("Gpl2LaterRef", "spdx license identifier gpl 2 0 or later"),
    ("Gpl3Ref", "licensed under the gpl version 3"),
    ("Gpl3Ref", "released under the gnu general public license version 3"),
    ("Gpl3Ref", "licensed under gpl 3 0"),
    ("Gpl2Ref", "released under the gnu general public license version 2"),
    ("MplRef", "spdx license identifier mpl 2 0"),
    ("MplRef", "licensed under the mozilla public license version 2 0"),
    ("MplTitle", "mozilla public license version 2 0"),
    ("EplRef", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("EplRef", "spdx license identifier epl 2 0"),
    ("IscTitle", "isc license"),
    ("IscRef", "spdx license identifier isc"),
    ("LiableIsc", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZlibRef", "spdx license identifier zlib"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("BoostRef", "distributed under the boost software license version 1 0"),
    ("BoostRef", "spdx license identifier bsl 1 0"),
    ("PostgresGrant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("WtfTitle", "do what the fuck you want to public license"),
    ("Cc0Ref", "spdx license identifier cc0 1 0"),
    ("Cc0Ref", "this work is licensed under cc0 1 0 universal license"),
    ("Cc0Ref", "licensed under cc0 1 0"),
    ("CcByRef", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("CcByRef", "licensed under a creative commons attribution 4 0 international license"),
    ("CcBySaRef", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CcBySaRef", "text is available under the creative commons attribution sharealike license"),
    ("CcBySaRef", "content is available under cc by sa 4 0 license"),
    ("CcByNcSaRef", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("CcByNcNdRef", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("CcByNdRef", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("Unlicense2", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("UnlicenseRef", "spdx license identifier unlicense"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("Reserved", "all rights reserved"),
]

# Sentences that name a holder, by what stands before and behind the name. A name with a full stop splits a sentence in two,
# which have their own identifiers.
_ENDORSE_END = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS_END = "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_LIABLE_END = "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
FRAMES: list[tuple[str, str, str]] = [
    ("BsdEndorse", "neither the name of ", f" {_ENDORSE_END}"),
    ("BsdEndorseBegin", "neither the name of ", ""),
    ("BsdEndorseEnd", "", _ENDORSE_END),
    ("AsIsBsd", "this software is provided by ", f" {_AS_IS_END}"),
    ("AsIsBsdBegin", "this software is provided by ", ""),
    ("AsIsBsdEnd", "", _AS_IS_END),
    ("LiableBsd", "in no event shall ", f" {_LIABLE_END}"),
    ("LiableBsdEnd", "", _LIABLE_END),
]
#: The ways in which splitting leaves the last sentences of a BSD notice.
_ENDORSED = [["BsdEndorse"], ["BsdEndorseBegin", "BsdEndorseEnd"]]
_BSD_END = [[*as_is, *liable] for as_is in (["AsIsBsd"], ["AsIsBsdBegin", "AsIsBsdEnd"]) for liable in (["LiableBsd"], ["LiableBsdEnd"], [])]

#: The ways in which splitting leaves the two first sentences of a GPL notice.
_GPL_FREE = {v: [[f"GplFree{v}"], ["GplProgram", "GplTerms", f"GplEither{v}"], ["GplProgramTerms", f"GplEither{v}"], ["GplProgram", f"GplTermsEither{v}"]] for v in (3, 2)}
_GPL_HOPE = [["GplHope"], ["GplUseful", "GplWithout"]]

# Rules in the order in which they are tried; each is a licence and a run of identifiers.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["MitTitle", "MitGrant", "MitNotice", "AsIsMit", "LiableMit"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsMit", "LiableMit"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsMit"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    *(("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAd", *own, *end]) for own in _ENDORSED for end in _BSD_END),
    *(("BSD-3-Clause", [*title, "BsdGrant", "BsdSource", "BsdBinary", *own, *end]) for title in (["BsdTitle"], []) for own in _ENDORSED for end in _BSD_END),
    *(("BSD-2-Clause", [*title, "BsdGrant", "BsdSource", "BsdBinary", *end]) for title in (["Bsd2Title"], []) for end in _BSD_END),
    *((f"GPL-{v}.0-or-later", [*free, *hope, *see]) for v in _GPL_FREE for free in _GPL_FREE[v] for hope in _GPL_HOPE for see in (["GplSee", "GplReceived"], ["GplSee"])),
    *((f"GPL-{v}.0-or-later", free) for v in _GPL_FREE for free in _GPL_FREE[v]),
    *((f"LGPL-{v}-or-later", run) for v, n in (("2.1", "21"), ("3.0", "3")) for run in (["LgplLibrary", f"LgplTerms{n}", "LgplUseful", "GplWithout", "LgplSee"], ["LgplLibrary", "LgplTerms", f"GplEither{n}", "LgplUseful", "GplWithout", "LgplSee"], ["LgplLibrary", f"LgplTerms{n}"], ["LgplLibrary", "LgplTerms", f"GplEither{n}"], ["GplProgram", f"LgplTerms{n}"])),
    ("AGPL-3.0-or-later", ["GplProgram", "AgplTermsEither3", "GplUseful", "GplWithout", "AgplSee"]),
    ("AGPL-3.0-or-later", ["GplProgram", "AgplTerms", "GplEither3", "GplUseful", "GplWithout", "AgplSee"]),
    ("AGPL-3.0-or-later", ["GplProgram", "AgplTermsEither3"]),
    ("AGPL-3.0-or-later", ["GplProgram", "AgplTerms", "GplEither3"]),
    ("X11", ["MitGrant", "MitNotice", "AsIsMit", "X11Name"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsMitHolders", "LiableMit"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheRef", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheTitle", "ApacheTerms"]),
    ("Apache-2.0", ["Apache2Grant", "ApacheCopyGrant"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAd"]),
    *(("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", *own]) for own in [*_ENDORSED, ["BsdEndorseBegin"]]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiable", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("PostgreSQL", ["PostgresGrant"]),
    ("MPL-2.0", ["MplForm", "MplCopy"]),
    ("MPL-2.0", ["MplForm"]),
    ("ISC", ["IscTitle", "IscGrant", "AsIsIsc", "LiableIsc"]),
    ("ISC", ["IscGrant", "AsIsIsc", "LiableIsc"]),
    ("ISC", ["IscGrant", "AsIsIsc"]),
    ("MIT", ["MitRef"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-3.0-or-later", ["Gpl3LaterRef"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("LGPL-3.0-only", ["LgplRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSaRef"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNdRef"]),
    ("CC-BY-ND-4.0", ["CcByNdRef"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("GPL-2.0-or-later", ["Gpl2LaterRef"]),
    ("GPL-3.0-only", ["Gpl3Title"]),
    ("GPL-2.0-only", ["Gpl2Title"]),
    ("LGPL-2.1-or-later", ["Lgpl21Ref"]),
    ("AGPL-3.0-only", ["AgplRef"]),
    ("MPL-2.0", ["MplRef"]),
    ("MPL-2.0", ["MplTitle"]),
    ("EPL-2.0", ["EplRef"]),
    ("ISC", ["IscRef"]),
    ("ISC", ["IscTitle"]),
    ("ISC", ["IscGrant"]),
    ("Zlib", ["ZlibRef"]),
    ("Zlib", ["ZlibGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("WTFPL", ["WtfTitle"]),
    ("BSD-3-Clause", ["BsdStyleRef"]),
    ("BSD-3-Clause", ["BsdTitle"]),
    ("BSD-2-Clause", ["Bsd2Title"]),
    ("Unlicense", ["UnlicenseFree", "Unlicense2"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Unlicense", ["UnlicenseRef"]),
    ("MIT", ["MitTitle"]),
    ("all-rights-reserved", ["Reserved"]),
]

#: Every known sentence holds one of these; a text with none is done without being split. Single words, or parts of
#: one, only: what stands between two words of a text is anything that isn't a letter or digit.
KEYWORDS = ["licen", "notice", "terms", "anyone", "consortium", "advertising", "neither", "event", "permission", "warrant", "redistribut", "liable", "reserved", "software", "apache", "gnu", "mpl", "unencumbered", "gpl", "endorse"]
#: Where a sentence ends. Single line breaks don't end one, as notices are wrapped.
SENTENCE_END = r"[.!?;]+[ \t\r\n]+|\n[ \t]*\n"
#: Marks of comments at the beginning of a line, which say nothing, and of list items, which end a sentence.
COMMENT_MARK = r"(?m)^[ \t]*(?://+!?|/\*+|\*+/|\*+|#+|--+|;+|%+|<!--|\.\.|dnl )[ \t]*"
ITEM_MARK = r"(?m)^[ \t]*(?:\(?(?:[0-9]{1,2}|[a-z]|i{1,3}|iv)[.)]|[-+o])[ \t]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, sentence in {s: n for n, s in SENTENCES}.items() for x in (name, sentence)])
    plain = F.regexp_replace(F.regexp_replace(text, COMMENT_MARK, ""), ITEM_MARK, "\n\n")

    def framed(sentence: Column) -> Column:
        cases = [F.when(sentence.startswith(begin) & sentence.endswith(end), name) for name, begin, end in FRAMES]
        return F.coalesce(known[sentence], *cases)

    found = F.transform(F.transform(F.split(plain, SENTENCE_END), normalised), framed)
    return F.filter(found, lambda i: i.isNotNull())


def _apply_rules(sequence: Column) -> Column:
    """Folds the ordered rules over a sequence: what is left of it, and the licences found so far."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for name, run in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["run"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit & ~F.array_contains(acc["names"], rule["name"]), F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(rules, start, step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentences, licenses and n_unmatched of every row.

    sentences: identifiers in order, joined by commas; licenses: by the order of the rules, each once, joined by
    commas; n_unmatched: known sentences that no rule took. Defined cases: a null or empty text has none
    (empty strings, zeros); a null id stays null; repeated rows are scanned each; an empty table gives an empty
    result. Other columns are ignored.
    """
    lower = F.lower(F.col("text"))
    likely = F.lit(False)
    for word in KEYWORDS:
        likely = likely | F.contains(lower, F.lit(word))
    none = F.array().cast("array<string>")
    found = ids_and_texts(docs, id_col, text_col).select("doc_id", F.when(likely, identifiers(F.col("text"))).otherwise(none).alias("ids"))
    applied = found.withColumn("done", F.when(F.size("ids") > 0, _apply_rules(F.concat(F.lit("|"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")))))
    return applied.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentences"),
        F.coalesce(F.array_join("done.names", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.length(F.regexp_replace("done.rest", "[^<]", "")), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def license_sql(table: str = "documents") -> str:
    """The same scan as DuckDB SQL."""
    values = ", ".join(f"('{n}', '{s}')" for n, s in SENTENCES)
    frames = " ".join(f"WHEN starts_with(n, '{begin}') AND suffix(n, '{end}') THEN '{name}'" for name, begin, end in FRAMES)
    names = []
    layers = []
    for k, (name, run) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in run)
        layers.append(f"r{k} AS (SELECT *, replace(rest{k}, '{pattern}', '|') AS rest{k + 1}, CASE WHEN contains(rest{k}, '{pattern}') THEN '{name}' END AS n{k} FROM {'seq' if k == 0 else f'r{k - 1}'})")
        names.append(f"n{k}")
    return rf"""
WITH known(id, sentence) AS (VALUES {values}),
parts AS (
  SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS k
  FROM (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '{COMMENT_MARK}', '', 'g'), '{ITEM_MARK}', chr(10) || chr(10), 'g'), '{SENTENCE_END}') AS p FROM {table})
), plain AS (SELECT doc_id, k, trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS n FROM parts),
hits AS (
  SELECT * FROM (SELECT doc_id, k, coalesce(known.id, CASE {frames} END) AS id FROM plain LEFT JOIN known ON known.sentence = n) WHERE id IS NOT NULL
), seq AS (
  SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY k) AS sentences,
         '|' || string_agg('<' || id || '>', '' ORDER BY k) AS rest0
  FROM hits GROUP BY doc_id
), {", ".join(layers)},
done AS (
  SELECT doc_id, n_sentences, sentences, array_to_string(list_filter(list_reduce([[x] FOR x IN [{", ".join(names)}] IF x IS NOT NULL], lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), lambda x: x IS NOT NULL), ',') AS licenses,
         length(regexp_replace(rest{len(RULES)}, '[^<]', '', 'g')) AS n_unmatched
  FROM r{len(RULES) - 1}
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentences, '') AS sentences,
       coalesce(licenses, '') AS licenses, coalesce(n_unmatched, 0) AS n_unmatched
FROM {table} d LEFT JOIN done USING (doc_id)
"""
