"""MATCH ... AGAINST: rows whose text has every term of the query. Exact, without ranking; both modes behave alike.

Terms are runs of letters and digits, lower case, without the stop words below. A query of stop words only matches nothing. A
term with marks is looked for in its composed and in its decomposed form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import text

#: English stop words that neither texts nor queries are searched for.
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was were with".split())


def query_terms(query: str) -> list[str]:
    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", query).lower())
    return [w for w in dict.fromkeys(words) if w not in STOP_WORDS]


def match_against(column, query: str) -> Column:
    terms = query_terms(query)
    if not terms:
        return F.lit(False)
    low, found = F.lower(text(column)), F.lit(True)
    for t in terms:
        forms = list(dict.fromkeys((t, unicodedata.normalize("NFD", t))))
        either = "|".join(map(re.escape, forms))
        # A substring test first: it is cheap, and most rows fail it.
        inside = reduce(lambda a, b: a | b, (low.contains(x) for x in forms))
        found = found & inside & low.rlike(rf"(?<![\p{{L}}\p{{N}}\p{{M}}])(?:{either})(?![\p{{L}}\p{{N}}\p{{M}}])")
    return F.coalesce(found, F.lit(False))
