"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no weight in routing and in search terms.
ROUTING_STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "what", "where", "which", "how", "when", "is", "in", "on", "to", "of", "a", "an", "are",
    "do", "does", "can", "could", "would",
)
TERM_STOPWORDS = (
    "a", "an", "and", "are", "does", "for", "how", "in", "is", "of", "or", "the", "to", "what", "where", "which", "who", "why",
)

#: What ends a line for file reads: line feed, carriage return, vertical tab, form feed, FS, GS, RS, NEL, LS, PS.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# The commonest English function words.
ENGLISH_STOPWORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "will", "with",
)


def routing_tokens(text: Column) -> Column:
    """Distinct tokens of 2 to 64 characters that are no stopwords, in order."""
    keep = lambda t: (F.length(t) >= 2) & (F.length(t) <= 64) & ~t.isin(*ROUTING_STOPWORDS)
    return F.array_distinct(F.filter(tokens(text), keep))


def query_terms(text: Column, most: int = 8) -> Column:
    """Search terms: runs of letters, digits and ``_./:-``, lower-case, edge marks stripped, two
    characters at least, no stopwords, the first ``most`` distinct ones in order."""
    raw = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_./:-]+"), F.lit(0))
    clean = F.transform(raw, lambda t: F.regexp_replace(F.lower(t), "^[._:/-]+|[._:/-]+$", ""))
    kept = F.filter(clean, lambda t: (F.length(t) >= 2) & ~t.isin(*TERM_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def collapse(text: Column) -> Column:
    """Runs of whitespace as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def with_snippet(rows: DataFrame, text: str, terms: Column, chars: int = 600) -> DataFrame:
    """rows with ``snippet`` and ``truncated``: a window of ``chars`` around the earliest term.

    The window starts a third before the match, or at the head without one. A cut end drops its
    partial word if a space is near enough and gets an ellipsis. The steps are columns of their
    own, so that none is worked out twice.
    """
    chars = max(80, min(4000, chars))
    lookback = 80
    out = rows.withColumn("_w", collapse(F.coalesce(text, F.lit(""))))
    out = out.withColumns({"_n": F.length("_w"), "_low": F.lower("_w")})
    out = out.withColumn("_at", F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, "_low")), lambda p: p > 0)) - 1)
    out = out.withColumn("_start", F.when(F.col("_at").isNull() | (F.col("_n") <= chars), 0).otherwise(F.greatest(F.lit(0), F.col("_at") - chars // 3)))
    out = out.withColumn("_end", F.least("_n", F.col("_start") + chars))
    out = out.withColumn("_start", F.when((F.col("_end") - F.col("_start") < chars) & (F.col("_start") > 0), F.greatest(F.lit(0), F.col("_end") - chars)).otherwise(F.col("_start")))
    out = out.withColumn("_cut", F.substring("_w", F.col("_start") + 1, F.col("_end") - F.col("_start")))
    tail = F.col("_end") < F.col("_n")
    out = out.withColumn("_space", F.length("_cut") - F.instr(F.reverse("_cut"), " "))
    whole_end = F.substring("_cut", -1, 1).rlike(r"""[\s.!?;:,)\]"']""")
    near = (F.instr("_cut", " ") > 0) & (F.col("_space") > 0) & (F.col("_space") >= F.length("_cut") - lookback)
    out = out.withColumn("_cut", F.when(tail & ~whole_end & near, F.rtrim(F.substring("_cut", F.lit(1), F.col("_space")))).when(tail, F.rtrim("_cut")).otherwise(F.col("_cut")))
    first = F.instr("_cut", " ") - 1
    head = F.when((first > 0) & (first <= lookback), F.substring("_cut", first + 2, F.length("_cut"))).otherwise(F.col("_cut"))
    out = out.withColumn("_cut", F.when(F.col("_start") > 0, F.concat(F.lit("…"), F.ltrim(head))).otherwise(F.col("_cut")))
    out = out.withColumns({"snippet": F.when(tail, F.concat(F.rtrim("_cut"), F.lit("…"))).otherwise(F.col("_cut")), "truncated": F.col("_n") > chars, "start": F.col("_start").cast("long")})
    return out.drop("_w", "_n", "_low", "_at", "_start", "_end", "_cut", "_space")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    padded = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded(w), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(tokens(text), of_word)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 without any."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def anchor(heading: Column) -> Column:
    low = F.regexp_replace(F.lower(heading), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(low, r"\s+", "-"), "^-+|-+$", "")


def link_kind(href: Column) -> Column:
    absolute = href.startswith("http://") | href.startswith("https://") | href.startswith("mailto:") | href.startswith("ftp://")
    return F.when(absolute, "absolute").when(href.startswith("#"), "anchor").when(href.endswith(".md") | href.endswith(".mdx"), "markdown").otherwise("relative")


def excerpt(markdown: Column, chars: int = 280) -> Column:
    """Text without heading marks, emphasis and backticks, cut to ``chars``."""
    return F.substring(F.trim(F.regexp_replace(markdown, r"(?m)^#+\s*|[*_`]+", "")), 1, chars)


def slug(path: Column) -> Column:
    """URL name of a document path: its docs prefix and extension dropped, the rest in ``-``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(?i)(docs|doc|documentation)/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def snake(name: Column) -> Column:
    """camelCase to snake_case, acronyms kept together."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def aliases(name: Column) -> Column:
    """Lower, snake and kebab spelling of a name, those of four characters or more."""
    return F.filter(F.array_distinct(F.array(F.lower(name), snake(name), F.replace(snake(name), F.lit("_"), F.lit("-")))), lambda a: F.length(a) >= 4)


def utf8_cap(text: Column, most: int) -> tuple[Column, Column]:
    """(text cut to at most ``most`` bytes on a character's edge, whether it was cut)."""
    raw = text.cast("binary")
    whole = F.octet_length(raw) <= most
    cut = lambda n: F.substring(raw, 1, n)
    # The first byte left out tells whether the cut is inside a character (10xxxxxx).
    inside = lambda n: F.substring(F.hex(F.substring(raw, n + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    back = F.when(~inside(most), cut(most)).when(~inside(most - 1), cut(most - 1)).when(~inside(most - 2), cut(most - 2)).otherwise(cut(most - 3))
    return F.when(whole, text).otherwise(back.cast("string")), ~whole


def lines(text: Column, first: int, last: int, most: int = 1000) -> tuple[Column, Column, Column]:
    """(text of lines first..last, last line given, truncated); 1-based, inclusive."""
    every = F.split(text, LINE_END)
    n = F.when(every[F.size(every) - 1] == "", F.size(every) - 1).otherwise(F.size(every))
    end = F.least(n, F.lit(last), F.lit(first + most - 1))
    return F.array_join(F.slice(every, first, F.greatest(end - first + 1, F.lit(0))), "\n"), end, end < F.least(n, F.lit(last))


def common_parent(paths: Column) -> Column:
    """Longest directory that all paths share, '' without one or with fewer than two paths."""
    parts = F.transform(paths, lambda p: F.split(F.regexp_replace(p, "/?[^/]*$", ""), "/"))
    low, high = F.array_min(parts), F.array_max(parts)
    same = F.aggregate(F.arrays_zip(low.alias("a"), high.alias("b")), F.struct(F.lit("").alias("p"), F.lit(True).alias("ok")), lambda acc, x: F.struct(F.when(acc["ok"] & x["a"].eqNullSafe(x["b"]), F.concat(acc["p"], F.when(acc["p"] == "", "").otherwise("/"), x["a"])).otherwise(acc["p"]).alias("p"), (acc["ok"] & x["a"].eqNullSafe(x["b"])).alias("ok")))
    return F.when(F.size(paths) < 2, "").otherwise(same["p"])


def bare_language(path: Column, table: dict[str, str]) -> Column:
    """Value of the path's lower-case extension in a fixed table."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[ext]
