"""Licence scan by canonical digest (built-in functions only).

A text is brought to a canonical form: A-Z lower-cased, copyright lines left
out (whole lines of at most COPYRIGHT_CHARS characters, with the comment sign
that may start them), equivalent spellings unified, everything but letters and
digits made one space.  The SHA-256 of the whole form is hash-joined to the digests of known
licences.  The known table is a parameter; the default has one row per licence
below, so its broadcast is bounded by this file.

With the default table, a text that has no match is brought to a core form too:
copyright lines without a year or sign, list markers, the title of a short
licence, and a copyright notice on the line of the text itself are left out
before the rest.  Its digest is looked up among those of
the whole licences below and of ``license_digests``, which holds long licences
with and without their title and their appendix.  The digest column stays that
of the canonical form.  Notices of one line match by the canonical form alone.

Defined cases: a null, empty or all-punctuation text has an empty form and
matches nothing; a text of one long line keeps its body though it begins with a
copyright notice; repeated rows give repeated results; several known ids with
one digest give the smallest id; texts are used whole, however long; an empty
table gives no rows.  Only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import ascii_lower

from .license_digests import DIGESTS

# Equivalent spellings (canonical form on the right).
EQUIVALENT = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("noninfringement", "non infringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"))

# Public licence texts.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
LICENSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# Lines that state an owner or a year; a wrapped line that starts with "copyright notice" is none.
COPYRIGHT_CHARS = 200
COPYRIGHT_WORD = "copyright|\\(c\\)|©|all rights reserved"
COPYRIGHT_LINE = "^[ \\t]*(?:[#*;/%!-]+[ \\t]*)?(?:copyright[^\\n]*(?:\\(c\\)|©|[0-9]{4})|\\(c\\)[ \\t]*[0-9]{4}|©|all rights reserved)"

# Lines that name an owner without a year: "Copyright The X Authors", "Copyright <year> <holder>".
BARE_COPYRIGHT_LINE = r"(?m)^[ \t]*(?:[#*;/%!-]+[ \t]*)?Copyright[ \t]+(?:by[ \t]+|of[ \t]+)?(?!Holder|Owner|Notice|Licen|Law|Act)[A-Z<\[{(][^\n]{0,200}$"
# A notice, perhaps after a title, that the licence follows on the same line.
LEAD = r"(?i)\A\s*(?:[^\n]{0,60}licen[sc]e[^\n]{0,20}\s)?(?:copyright|\(c\)|©)[^\n]{0,300}?(?=permission is hereby granted|permission to use, copy|redistribution and use in source)"
LIST_MARKER = r"(^|[\n:;.])\s{0,40}+(?!\([cC]\)[ \t]*[0-9]{4})\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{1,4})[.)]\s"
TITLE = r"^(?:the )?(?:mit|expat|isc|zlib|0bsd|(?:[023] clause |zero clause |new |modified |revised |simplified )?bsd(?: [023] clause| zero clause)?) license(?: mit| expat| isc| 0bsd)? "
# Words of which every whole licence has one; other texts need no core form.
LICENSE_WORD = "(?i)licen[sc]e|permission|redistribution"


def canonical(text: Column) -> Column:
    form = ascii_lower(F.coalesce(text, F.lit("")))
    stated = lambda line: line.rlike(COPYRIGHT_LINE) & (F.length(line) <= COPYRIGHT_CHARS)
    form = F.when(form.rlike(COPYRIGHT_WORD), F.array_join(F.filter(F.split(form, "\n"), lambda line: ~stated(line)), "\n")).otherwise(form)
    form = F.concat(F.lit(" "), F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in EQUIVALENT:
        form = F.replace(form, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(form, F.lit(" "))


def core(text: Column) -> Column:
    """The canonical form without title, list markers and bare copyright lines."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), BARE_COPYRIGHT_LINE, ""), LEAD, "")
    bare = F.regexp_replace(bare, LIST_MARKER, "$1 ")
    return F.regexp_replace(canonical(bare), TITLE, "")


def known_cores(spark: SparkSession) -> DataFrame:
    """Rows (core_digest, core_id) of whole licences."""
    rows = F.array(*[F.struct(F.lit(name).alias("core_id"), F.lit(text).alias("text")) for name, text in LICENSES.items() if not name.startswith("notice:")])
    short = spark.range(1).select(F.inline(rows)).select("core_id", F.sha2(core(F.col("text")), 256).alias("core_digest"))
    long = F.array(*[F.struct(F.lit(name).alias("core_id"), F.lit(digest).alias("core_digest")) for name, digest in DIGESTS])
    every = short.unionByName(spark.range(1).select(F.inline(long)))
    return every.groupBy("core_digest").agg(F.min("core_id").alias("core_id"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """Rows (license_id, digest) of the default table."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in LICENSES.items()])
    return spark.range(1).select(F.inline(rows)).select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, canonical_chars, digest, license_id or null)."""
    one = (known_licenses(docs.sparkSession) if known is None else known).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    column = F.col(text)
    named = [F.when(column.rlike(LICENSE_WORD), F.sha2(core(column), 256)).alias("core_digest")] if known is None else []
    form = docs.select(F.col(key), canonical(column).alias("form"), *named)
    forms = form.select(key, F.length("form").cast("long").alias("canonical_chars"), F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"), *["core_digest" for _ in named])
    found = forms.join(F.broadcast(one) if known is None else one, "digest", "left")
    if known is None:
        found = found.join(F.broadcast(known_cores(docs.sparkSession)), "core_digest", "left").withColumn("license_id", F.coalesce("license_id", "core_id"))
    return found.select(key, "canonical_chars", "digest", "license_id")
