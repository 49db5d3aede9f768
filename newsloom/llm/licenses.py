"""License notices found in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.containment import contained, windows

#: Customary notices of public licenses, by SPDX id. Each is cut to a span of which less than 80 percent
#: is left once another license's name or version stands in it.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("LicenseRef-BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "under the GNU General Public License, version 2"),
    ("GPL-3.0", "under the GNU General Public License, version 3"),
    ("GPL-3.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("AGPL-3.0", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE"),
    ("BSD-3-Clause", "and/or other materials provided with the distribution. 3. Neither the name of"),
    ("BSD-3-Clause", "and/or other materials provided with the distribution. Neither the name of"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-1.0", "terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "terms of the Eclipse Public License v2.0"),
    ("EPL-2.0", "terms of the Eclipse Public License v. 2.0"),
    ("GPL-2.0", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June"),
    ("LGPL-2.1", "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
for _v, _kind in _VERSIONS.items():
    for _short, _long in _CREATIVE.items():
        _forms = [f"Licensed under CC {_short} {_v}.", f"licensed under a Creative Commons {_long} {_v} {_kind} License"]
        _forms += [f"Creative Commons {_long} {_v} International Public License"] if _v == "4.0" else []
        if "NoDerivatives" in _long and _v != "4.0":
            _forms.append(_forms[1].replace("NoDerivatives", "NoDerivs"))
        NOTICES += [(f"CC-{_short}-{_v}", t) for t in _forms if (f"CC-{_short}-{_v}", t) not in NOTICES]


def notices(spark: SparkSession, texts: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(item_id, license, text)."""
    rows = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(a).alias("license"), F.lit(b).alias("text")) for i, (a, b) in enumerate(texts)])
    return spark.range(1).select(F.inline(rows))


def license_scan(docs: DataFrame, templates: DataFrame, size: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, item_id, license, n_shared, n_shingles, n_windows): templates of which some window of a text holds 80 percent.

    Windows overlap by half and are twice as long as the longest template of the size class, so a
    template's words lie whole in one of them. Null and empty texts match nothing.
    """
    hits = contained(docs, templates, windows, size, percent, text, ident)
    names = templates.select(F.col("item_id").alias("item"), "license")
    return hits.join(names, "item").select(F.col("id").alias(ident), F.col("item").alias("item_id"), "license", "n_shared", "n_shingles", F.col("n_parts").alias("n_windows"))
