"""License scan by canonical digests (operator 5), DataFrame operations only.

A text's canonical form: notice lines dropped (copyright or (c) followed by a year, (c) or a name, and 'all rights
reserved' as the whole line); A-Z lower-cased; line breaks and white space folded, then equivalent spellings unified;
every run of characters other than letters and digits turned into one space.  So it doesn't depend on where lines break,
as long as a notice has a line of its own.
The SHA-256 of the canonical whole text is hash-joined to the digests of known licences
(a fixed table of a few rows, so its broadcast has a proven bound).  The canonical lines of the text are
matched against the same digests, which finds licence notices that stand as a line of a longer document.

Every pattern takes linear time and no stack, so lines, words and runs of any length (megabytes) are scanned whole.

Defined cases: a null text counts as empty, its canonical form is empty and is no licence; repeated rows are
scanned one by one; a null id stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

# Spellings that count as equal, the second form is the canonical one.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("copyright holder", "copyright owner"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"),
    ("analogue", "analog"), ("http:", "https:"), ("per cent", "percent"), ("wilful", "willful"),
)

# What may stand before a notice on its line.
LEAD = r"[ \t/*#;>-]*"
# Notice lines of lower-cased text; a line of prose that opens with 'copyright holders' or '(c) you must' is none.
COPYRIGHT_LINE = (rf"^{LEAD}(copyright[ \t:,]*(\(c\)|©|[<\[{{(]?[0-9]{{4}}|[<\[{{(]?yyyy|[<\[{{(]year)|"
                  r"\(c\)[ \t:,]*(copyright|[<\[{(]?[0-9]{4}|[<\[{(]?yyyy|[<\[{(]year)|©)|"
                  rf"^{LEAD}all rights reserved[ \t\r.*/]*$")
# Notice lines that only their capitals tell from prose: 'Copyright Jane Doe and the Example Authors', '(c) Jane Doe'.
# Every word is tested by itself, so that a line of any length takes linear time.
NAME_HEAD = rf"^{LEAD}([Cc]opyright|COPYRIGHT|\([cC]\))[ \t:,]+"
NAME_WORD = r"^[A-ZÀ-ÖØ-Þ][^\x09-\x0D ,;:()]*$"
SMALL = r"[a-zà-öø-ÿ]"
INITIAL = r"^[A-Z]\.?$"
NOT_A_NAME = r"^(Holder|Owner|Notice|License|Licence|Law|Act|Treaty|Right|Statement)s?([^A-Za-z0-9_]|$)"
BEFORE_NAME = ("by", "the", "The")
BETWEEN_NAMES = ("and", "of", "by", "the", "&")
ADDRESS = r"[ \t,]<[^<>]*>"
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# Licence texts and notices as published.
KNOWN = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}
KNOWN |= {f"{k}+untitled": KNOWN[k].partition("\n\n")[2] for k in ("MIT", "ISC")}

_BSD = ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:""", (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""), """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""")
for _n in (2, 3):
    for _title in (f"BSD {_n}-Clause License", ""):
        for _numbered in (True, False):
            KNOWN[f"BSD-{_n}-Clause" + "+untitled" * (not _title) + "+bullets" * (not _numbered)] = "\n\n".join(
                [_title, _BSD[0], *((f"{i}. " if _numbered else "* ") + x for i, x in enumerate(_BSD[1][:_n], 1)), _BSD[2]]).strip()

# Digests of longer whole texts, in the wording of Debian's /usr/share/common-licenses.
WHOLE = {
    "Apache-2.0-text": "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc",
    "Apache-2.0-text+no-appendix": "4f14b6cbdd362d5a6d1023eaee7538d57a6c9271c5e1de4bdc60e02a182c0730",
    "Apache-2.0-text+no-end": "ac68c71d53e621b3beea1252644799f10f9c4712422f05798ef36f47219e5ad1",
    "GPL-2.0-text": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0-text": "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1",
    "LGPL-2.1-text": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0-text": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-2.0-text": "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13",
    "CC0-1.0-text": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
}


def _is_name(word: Column) -> Column:
    return word.rlike(NAME_WORD) & F.substring(word, 2, 1 << 30).rlike(SMALL)


def _names_only(line: Column) -> Column:
    """Is what follows the head of a notice a list of names?"""
    rest = F.rtrim(F.regexp_replace(F.regexp_replace(line, NAME_HEAD, ""), ADDRESS, " &"), F.lit(" \t\r."))
    words = F.split(rest, r"[ \t,]+")
    first = F.get(F.filter(words, lambda w: ~w.isin(*BEFORE_NAME)), F.lit(0))
    listed = F.forall(words, lambda w: w.isin(*BETWEEN_NAMES) | w.rlike(INITIAL) | _is_name(w))
    return F.coalesce(_is_name(first) & ~first.rlike(NOT_A_NAME) & listed, F.lit(False))


def _is_notice(line: Column) -> Column:
    return lower_ascii(line).rlike(COPYRIGHT_LINE) | F.when(line.rlike(NAME_HEAD), _names_only(line)).otherwise(F.lit(False))


def _body(text: str) -> Column:
    """The lower-cased lines of the text; notice lines are empty."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.transform(F.split(whole, "\n"), lambda x: F.when(_is_notice(x), F.lit("")).otherwise(lower_ascii(x)))


def _unified(c: Column) -> Column:
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, NOT_WORD, " ")


def canonical(body: Column) -> Column:
    """The canonical lines; words are separated by one space."""
    return _unified(F.regexp_replace(F.array_join(body, "\n"), r"[ \t]+", " "))


def one_line(body: Column) -> Column:
    """The canonical text in one line: line breaks are folded before spellings are unified."""
    ends = F.transform(body, lambda x: F.rtrim(x, F.lit(" \t\r")))
    lines = F.transform(ends, lambda x, i: F.when(i == 0, x).otherwise(F.ltrim(x, F.lit(" \t/*#;>-"))))
    c = F.replace(F.replace(F.array_join(lines, "\n"), F.lit("-\n"), F.lit("-")), F.lit("\n"), F.lit(" "))
    return F.trim(_unified(F.regexp_replace(c, r"[ \t\r]+", " ")))


def _lower(text: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def is_notice_line(line: str) -> bool:
    """The same rule for one line, for the fixed table."""
    if re.search(COPYRIGHT_LINE, _lower(line)):
        return True
    if not re.search(NAME_HEAD, line):
        return False
    rest = re.sub(ADDRESS, " &", re.sub(NAME_HEAD, "", line)).rstrip(" \t\r.")
    words = re.split(r"[ \t,]+", rest)
    name = lambda w: bool(re.search(NAME_WORD, w) and re.search(SMALL, w[1:]))
    first = next((w for w in words if w not in BEFORE_NAME), "")
    return (name(first) and not re.search(NOT_A_NAME, first)
            and all(w in BETWEEN_NAMES or bool(re.search(INITIAL, w)) or name(w) for w in words))


def canonical_text(text: str) -> str:
    """The canonical form of one text in one line, for the fixed table."""
    lines = ["" if is_notice_line(x) else _lower(x).rstrip(" \t\r") for x in text.split("\n")]
    c = "\n".join(x if not i else x.lstrip(" \t/*#;>-") for i, x in enumerate(lines)).replace("-\n", "-").replace("\n", " ")
    c = re.sub(r"[ \t\r]+", " ", c)
    for old, new in SPELLINGS:
        c = c.replace(old, new)
    return re.sub(r"[\W_]+", " ", c).strip()


def digests(known: Mapping[str, str] = KNOWN, whole: Mapping[str, str] = WHOLE) -> dict[str, str]:
    """licence id -> SHA-256 of its canonical text; what follows a + in the id names the variant of the text."""
    return {k: hashlib.sha256(canonical_text(v).encode()).hexdigest() for k, v in known.items()} | dict(whole)


def license_scan(docs: DataFrame, known: Mapping[str, str] = KNOWN, doc_id: str = "doc_id", text: str = "text",
                 whole: Mapping[str, str] = WHOLE) -> DataFrame:
    """One row per document: ``doc_id, text_digest, license_id`` (of the entire text, or null), ``n_notices`` and
    ``notice_ids`` (the known texts that are a line of it, sorted, comma-separated)."""
    spark: SparkSession = docs.sparkSession
    by = digests(known, whole)
    table = spark.createDataFrame([(v, k) for k, v in by.items()], "text_digest string, license_id string")
    c = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _body(text).alias("body"))
    line_digests = F.transform(F.split(canonical(F.col("body")), "\n"), lambda x: F.sha2(F.trim(x), 256))
    known_list = F.array(*[F.lit(v) for v in by.values()])
    hits = F.filter(line_digests, lambda x: F.array_contains(known_list, x))
    c = c.select("doc_id", F.sha2(one_line(F.col("body")), 256).alias("text_digest"), hits.alias("hits"))
    names = F.create_map(*[F.lit(x) for k, v in by.items() for x in (v, k)])
    return (c.join(F.broadcast(table), "text_digest", "left")
            .select("doc_id", "text_digest", "license_id", F.size("hits").cast("long").alias("n_notices"),
                    F.array_join(F.array_sort(F.transform(F.array_distinct("hits"), lambda x: F.element_at(names, x))), ",")
                    .alias("notice_ids")))
