"""Licence scan by sentence rules.

Texts are normalised to lower-case words, so that line breaks, indentation, comment
marks and punctuation do not matter; known licence sentences are found in them
wherever they stand, and the sequence of their numbers is matched against licence
rules: ordered sentences that stand next to each other once other text is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences by identifier.
SENTENCES = {
    "ApacheRef": "licensed under the apache license version 2 0",
    "ApacheUse": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "ApacheWarranty": "unless required by applicable law or agreed to in writing software distributed under "
                      "the license is distributed on an as is basis without warranties or conditions of any "
                      "kind either express or implied",
    "MitRef": "released under the mit license",
    "MitRef2": "licensed under the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software "
                "and associated documentation files the software to deal in the software without restriction "
                "including without limitation the rights to use copy modify merge publish distribute "
                "sublicense and or sell copies of the software and to permit persons to whom the software is "
                "furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or "
                 "substantial portions of the software",
    "MitWarranty": "the software is provided as is without warranty of any kind express or implied including "
                   "but not limited to the warranties of merchantability fitness for a particular purpose and "
                   "noninfringement",
    "Gpl3Ref": "this work is licensed under the gnu general public license version 3",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the "
               "gnu general public license as published by the free software foundation either version 3 of "
               "the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty "
               "without even the implied warranty of merchantability or fitness for a particular purpose",
    "CcByNcRef": "licensed under cc by nc 4 0",
    "CcByRef": "licensed under cc by 4 0",
    "CcBySaRef": "licensed under cc by sa 4 0",
    "Bsd": "redistribution and use in source and binary forms with or without modification are permitted "
           "provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of "
                 "conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of "
                 "conditions and the following disclaimer in the documentation and or other materials "
                 "provided with the distribution",
}

# Licences by their ordered sentences.
RULES = (
    ("Apache-2.0", ("ApacheRef",)),
    ("Apache-2.0-notice", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheWarranty")),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitRef2",)),
    ("MIT-text", ("MitGrant", "MitNotice", "MitWarranty")),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-3.0-or-later", ("GplFree", "GplHope")),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("BSD-2-Clause", ("Bsd", "BsdSource", "BsdBinary")),
)

_SAID = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
_GPL3 = ("the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl version 3",
         "the gnu gpl v3", "the gpl version 3", "the gpl v3", "gpl v3", "gplv3")
_LATER = ("or later", "or any later version", "or at your option any later version")
_CC = "creative commons attribution"


def _under(*names: str) -> tuple[str, ...]:
    return tuple(f"{said} {name}" for said in _SAID for name in names)


# Other wordings of the sentences, and sentences of further rules.
VARIANTS = {
    "ApacheRef": (*_under("the apache license version 2 0", "the apache license 2 0", "apache license 2 0",
                          "apache license version 2 0", "the apache 2 0 license", "apache 2 0"),
                  "spdx license identifier apache 2 0"),
    "ApacheCopy": ("you may obtain a copy of the license at https www apache org licenses license 2 0",),
    "MitRef": (*_under("the mit license", "mit license", "an mit license"), "spdx license identifier mit"),
    "MitWarranty": (SENTENCES["MitWarranty"].replace("noninfringement", "non infringement"),),
    "Gpl3Ref": (*_under(*_GPL3), "spdx license identifier gpl 3 0 only"),
    "Gpl3LaterRef": (*(f"{ref} {later}" for ref in (SENTENCES["Gpl3Ref"], *_under(*_GPL3)) for later in _LATER),
                     "spdx license identifier gpl 3 0 or later"),
    "CcByNcRef": _under("the cc by nc 4 0", f"a {_CC} noncommercial 4 0", f"the {_CC} noncommercial 4 0",
                        f"a {_CC} non commercial 4 0"),
    "CcByRef": _under("the cc by 4 0", f"a {_CC} 4 0", f"the {_CC} 4 0"),
    "CcBySaRef": _under("the cc by sa 4 0", f"a {_CC} sharealike 4 0", f"the {_CC} sharealike 4 0",
                        f"a {_CC} share alike 4 0"),
    "BsdNames": ("names of its contributors may be used to endorse or promote products derived from this "
                 "software without specific prior written permission",),
    "GplHope": (SENTENCES["GplHope"].replace("this program", "this library"),),
    **{name: tuple(
        f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu "
        f"{kind}general public license as published by the free software foundation either version {version} of "
        "the license or at your option any later version" for work in ("program", "library"))
       for name, kind, version in (
           ("Gpl2Free", "", "2"), ("Lgpl21Free", "lesser ", "2 1"), ("Lgpl3Free", "lesser ", "3"),
           ("AgplFree", "affero ", "3"))},
    "MplForm": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                *_under("the mozilla public license version 2 0", "the mozilla public license 2 0", "mpl 2 0"),
                "spdx license identifier mpl 2 0"),
    "IscGrant": ("permission to use copy modify and or distribute this software for any purpose with or without "
                 "fee is hereby granted provided that the above copyright notice and this permission notice "
                 "appear in all copies", *_under("the isc license"), "spdx license identifier isc"),
    "UnlicenseFree": ("this is free and unencumbered software released into the public domain",
                      "spdx license identifier unlicense"),
    "Gpl2Ref": (*_under("the gnu general public license version 2", "the gnu gpl version 2", "the gpl v2", "gpl v2",
                        "gplv2"), "spdx license identifier gpl 2 0 only"),
    "LgplRef": ("spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"),
    "AgplRef": (*_under("the gnu affero general public license version 3", "the gnu agpl version 3", "agpl v3"),
                "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"),
}
MORE_RULES = (
    ("GPL-3.0-or-later", ("Gpl3LaterRef",)),
    ("BSD-3-Clause", ("Bsd", "BsdSource", "BsdBinary", "BsdNames")),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope")),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("LGPL-2.1-or-later", ("Lgpl21Free", "GplHope")),
    ("LGPL-2.1", ("LgplRef",)),
    ("LGPL-3.0-or-later", ("Lgpl3Free", "GplHope")),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope")),
    ("AGPL-3.0", ("AgplRef",)),
    ("MPL-2.0", ("MplForm",)),
    ("ISC", ("IscGrant",)),
    ("Unlicense", ("UnlicenseFree",)),
)

#: words that mark a line as a comment
REMARK = "(?m)^[ \\t]*(?:rem|dnl)(?=[ \\t])"
#: what a normalised text has one blank for
OTHER = "[^a-z0-9]+"
#: what makes a sentence say the opposite
NEGATED = ("\\bnot", "\\bnever", "n t", "\\bnot be", "\\bnot been", "\\bno longer")


def known_sentences() -> dict[str, str]:
    """Identifiers by normalised sentence; the given wordings win."""
    return {v: name for name, said in VARIANTS.items() for v in said} | {v: k for k, v in SENTENCES.items()}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; of no text, none."""
    known = known_sentences()
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # At one place the longest sentence wins.
    said = "|".join(sorted(known, key=lambda k: (-len(k), k)))
    pattern = "".join(f"(?<!{n} )" for n in NEGATED) + f"\\b(?:{said})\\b"
    low = F.lower(F.coalesce(text, F.lit("")))
    # Most texts have no licence; the cheap test leaves few to normalise.
    normal = F.when(low.rlike("licen|permi|distribut|softw"),
                    F.regexp_replace(F.regexp_replace(low, REMARK, " "), OTHER, " ")).otherwise(F.lit(""))
    return F.transform(F.regexp_extract_all(normal, F.lit(pattern), F.lit(0)), lambda s: F.element_at(names, s))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids and licenses of each row of ``docs``.

    ``sentence_ids`` are joined by blanks, in order of the text; ``licenses`` are
    those whose rule occurs, joined by commas, in order of the rules; a two-clause
    rule that goes on to the third clause counts as that only.  Licences known: Apache 2.0, MIT,
    BSD (2 and 3 clauses), ISC, GPL 2 and 3, LGPL 2.1 and 3, AGPL 3, MPL 2.0, Unlicense and
    Creative Commons 4.0 (BY, BY-SA, BY-NC), by their notices or by reference.  Texts
    without licence sentences, empty and null ones have empty strings.  Repeated
    rows and null ids are reported as they are; other columns are ignored.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), sentence_ids(F.col(text_col)).alias("ids")
    )
    sequence = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    # Where BSD-3-Clause has been taken out, BSD-2-Clause is left only if it stands by itself.
    longer = f" {' '.join(MORE_RULES[1][1])} "
    met = [
        F.when((F.replace(sequence, F.lit(longer), F.lit(" ")) if name == "BSD-2-Clause" else sequence)
               .contains(f" {' '.join(rule)} "), F.lit(name))
        for name, rule in (*RULES, *MORE_RULES)
    ]
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*met))), ",").alias("licenses"),
    )
