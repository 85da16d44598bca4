"""Raw web pages to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What goes whole, what ends a line, and the entities that are read.
_GONE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BREAK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|title|head|body)[^>]*>"
_TAG = r"<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _GONE, ""), _BREAK, "\n"), _TAG, "")
    for a, b in _ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, text): lines with text, trimmed, from 1 on."""
    parts = F.filter(F.transform(F.split(plain(F.col("html")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("page_id", F.posexplode(parts).alias("i", "text")).select("page_id", (F.col("i") + 1).alias("line_no"), "text")


_sql = f"regexp_replace(regexp_replace(regexp_replace(html, '{_GONE}', '', 'g'), '{_BREAK}', chr(10), 'g'), '{_TAG}', '', 'g')"
for _a, _b in _ENTITIES:
    _sql = "replace({}, '{}', '{}')".format(_sql, _a, _b.replace("'", "''"))
SQL = f"SELECT page_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT page_id, list_filter(list_transform(string_split({_sql}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)"
