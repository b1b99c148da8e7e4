import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import keys, text, vector
from lodestone.operators import retrieval as R


def stream(spark, ids):
    return spark.createDataFrame([(i, 1.0 - k / 100) for k, i in enumerate(ids)], "id string, score double")


def test_fusion_sums_reciprocal_ranks(spark):
    got = {r["id"]: r for r in R.fuse({"s1": stream(spark, "ab"), "s2": stream(spark, "bc"), "s3": stream(spark, "acb")}).collect()}
    assert got["a"]["score"] == pytest.approx(2 / 61) and got["b"]["score"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 63) and got["c"]["score"] == pytest.approx(2 / 62)
    assert max(got, key=lambda i: got[i]["score"]) == "b" and got["a"]["s2_rank"] == 0


def test_fusion_cap_tie_and_bad_k(spark):
    capped = R.fuse({"s": stream(spark, "abcdefghij")}, cap=3).collect()
    assert sorted(r["id"] for r in capped) == ["a", "b", "c"]
    tied = R.fuse({"x": stream(spark, "b"), "y": stream(spark, "a")}).orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in tied] == ["a", "b"]
    assert R.fuse({f"s{k}": stream(spark, "z") for k in range(5)}).first()["score"] == pytest.approx(5 / 61)
    with pytest.raises(ValueError, match="k must be positive"):
        R.fuse({"s": stream(spark, "a")}, k=0)


def brute_covers(found, n):
    """All windows that hold every word and whose both ends are needed."""
    total = 0.0
    for i in range(len(found)):
        for j in range(i, len(found)):
            inside = found[i : j + 1]
            if {w for _, w, _ in inside} != set(range(n)):
                continue
            if all({w for _, w, _ in part} != set(range(n)) for part in (inside[1:], inside[:-1])):
                noise = inside[-1][0] - inside[0][0] - (len(inside) - 1)
                total += len(inside) / sum(1 / x for _, _, x in inside) / (1 + noise)
    return total


def test_cover_density_matches_all_minimal_windows():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 3)
        found = [(p, draw.randrange(n), draw.choice([0.1, 0.2, 0.4, 1.0])) for p in sorted(draw.sample(range(30), draw.randint(0, 9)))]
        assert R._cover_score(found, n) == pytest.approx(brute_covers(found, n))


def test_lexical_needs_every_word_and_weighs_fields(spark):
    docs = spark.createDataFrame([(1, "fetch user", "x"), (2, "other", "fetch the user"), (3, "fetch", "nothing"), (4, None, None)], "id long, name string, body string")
    got = {r["id"]: r["score"] for r in R.lexical_stream(docs, "fetch User", 10, "id", {"A": "name", "D": "body"}).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.1 / 2)
    assert R.lexical_stream(docs, "...", 10, "id", {"A": "name"}).count() == 0


def test_vector_stream_skips_unusable_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["id"], r["score"]) for r in R.vector_stream(rows, [1.0, 0.0], 5).collect()]
    assert got[0] == (1, 1.0) and got[1][0] == 2 and got[1][1] == pytest.approx(1 / math.sqrt(2)) and len(got) == 3 and got[2][1] is None


def test_rerank_gate(spark):
    rows = lambda n, name: spark.createDataFrame([(k + 1, name if k == 1 else "x.y") for k in range(n)], "rank long, name string")
    wanted = lambda *a, **b: R.rerank_wanted(*a, **b).first()[0]
    assert wanted(rows(50, "a.b"), "q") and not wanted(rows(49, "a.b"), "q") and not wanted(rows(60, "pkg.Q"), "q")
    assert not wanted(rows(60, "a"), " ") and not wanted(rows(60, "a"), "q", enabled=False) and not wanted(rows(0, "a"), "q")


def python_snippet(content, terms, chars):
    """The excerpt rule in plain Python."""
    whole = re.sub(r"\s+", " ", content or "").strip()
    if len(whole) <= chars:
        return whole, False
    at = min((p for p in (whole.lower().find(t) for t in terms) if p >= 0), default=-1)
    a = 0 if at < 0 else max(0, at - chars // 3)
    b = min(len(whole), a + chars)
    a = max(0, b - chars) if b - a < chars else a
    cut = whole[a:b]
    if b < len(whole):
        space = cut.rfind(" ")
        cut = cut[:space] if cut[-1] not in " .!?;:,)]\"'" and space > 0 and space >= len(cut) - 80 else cut
        cut = cut.rstrip()
    if a > 0:
        space = cut.find(" ")
        cut = "…" + (cut[space + 1 :] if 0 < space <= 80 else cut).lstrip()
    return (cut.rstrip() + "…" if b < len(whole) else cut), True


def test_snippets_match_the_rule(spark):
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcé") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 90))) for _ in range(120)] + ["x" * 500, "", None, "needle " + "y" * 300, "z" * 300 + " needle"]
    texts = [t if t is None or k % 3 else t[: len(t) // 2] + " needle\n\n" + t[len(t) // 2 :] for k, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for r in text.with_snippet(df, "t", F.array(F.lit("needle"), F.lit("zzz")), 100).collect():
        assert (r["snippet"], r["truncated"]) == python_snippet(texts[r["id"]], ["needle", "zzz"], 100), texts[r["id"]]
        assert len(r["snippet"]) <= 102


def test_text_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert one(text.anchor(lit("Hello, Wörld! -- it's")), text.link_kind(lit("a/b.md")), text.link_kind(lit("#x")), text.link_kind(lit("mailto:a")), text.link_kind(lit("../a"))) == ("hello-wörld----its", "markdown", "anchor", "absolute", "relative")
    assert one(text.aliases(lit("AccountBalance")), text.aliases(lit("Id")), text.snake(lit("HTTPServer"))) == (["accountbalance", "account_balance", "account-balance"], [], "http_server")
    assert one(text.slug(lit("docs/Guide/Getting Started.md")), text.excerpt(lit("# A *b* `c`\ntext"))) == ("guide-getting-started", "A b c\ntext")
    assert one(*text.utf8_cap(lit("aé€😀z"), 6)) == ("aé€", True) and one(*text.utf8_cap(lit("aé€😀z"), 9)) == ("aé€", True) and one(*text.utf8_cap(lit("abc"), 3)) == ("abc", False)
    assert one(*text.lines(lit("a\nb\r\nc\x0cd\n"), 2, 9)) == ("b\nc\nd", 4, False) and one(*text.lines(lit("a\nb\nc"), 1, 3, 2)) == ("a\nb", 2, True)
    assert one(text.common_parent(F.array(lit("a/b/c.py"), lit("a/b/d/e.py"))), text.common_parent(F.array(lit("a/x.py"), lit("b/y.py"))), text.common_parent(F.array(lit("a/x.py")))) == ("a/b", "", "")
    assert one(text.query_terms(lit("How does the auth.Token_v2 work? auth.token_v2 /path/ x"))) == (["auth.token_v2", "work", "path"],)
    assert one(keys.neighbour_hash(F.array(lit("b"), lit("a")), F.array(lit("c")))) == one(keys.neighbour_hash(F.array(lit("a"), lit("b")), F.array(lit("c"))))
    assert one(vector.cosine(F.array(lit(1.0)), F.array(lit(1.0), lit(2.0))), vector.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == (0.0, 0.0)


def test_hybrid_orders_stores_and_leaves_out_broken_streams(spark):
    from lodestone.operators import hybrid as H

    rows = spark.createDataFrame([(1, "load config"), (2, "save"), (3, "load")], "id long, name string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    code = H.Store(rows, "id", {"A": "name"}, vectors, symbol="name")
    docs = H.Store(rows, "id", {"D": "name"})
    got = [(r["store"], r["id"]) for r in H.hybrid({"code": code, "repo_docs": docs}, "load", [1.0, 0.0], 10).collect()]
    assert got[0] == ("code", "1") and ("repo_docs", "3") in got and len(got) == len(set(got)) <= 10
    blank = H.hybrid({"code": code}, "  ", [1.0, 0.0], 10).collect()
    assert [r["id"] for r in blank] == ["1", "2"]
    broken = H.Store(rows, "id", {"A": "no_such_column"}, vectors)
    assert [r["id"] for r in H.hybrid({"code": broken}, "load", [1.0, 0.0], 5).collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="nothing"):
        H.hybrid({"code": docs}, " ", None, 5)


def test_modes_and_windows(spark):
    import datetime as dt

    from lodestone.operators import hybrid as H

    assert H.stores_of(H.layers_of("wiki")) == {"repo_docs"} and "ast" not in H.layers_of("mixed")
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    with pytest.raises(ValueError, match="until"):
        H.check_window(b, a, None)
    rows = spark.createDataFrame([(1, None, a), (2, b, a), (3, a, b)], "id int, changed timestamp, created timestamp")
    assert sorted(r["id"] for r in H.in_window(rows, "changed", "created", until=a).collect()) == [1, 3]


# Words and stems of the algorithm's published vocabulary.
VOCABULARY = (
    "consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist|consolation consol|"
    "consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson|"
    "consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|"
    "constables constabl|constance constanc|constancy constanc|constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|"
    "kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|"
    "knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock|"
    "knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot|generate generat|generously generous|happy happi|flies fli|"
    "ties tie|cries cri|by by|say say|dying die|hopping hop|hoping hope|luxuriated luxuri|feed feed|agreed agre|relational relat|rational ration|"
    "national nation|sensational sensat|electricity electr|hopefulness hope|goodness good|analogies analog|possibly possibl|gas gas|this this|gaps gap|kiwis kiwi|youth youth|"
    "boy boy|boyish boyish|saying say|news news|inning inning|innings inning|communities communiti|disabled disabl|beds bed|bedding bed|licensed licens|licenses licens|"
    "license licens|licensing licens|controlled control|controlling control|rolled roll|falling fall"
)


def test_english_stems(spark):
    from lodestone.functions.stem import english_stems, stem

    assert {w: stem(w) for w, _ in (x.split() for x in VOCABULARY.split("|"))} == dict(x.split() for x in VOCABULARY.split("|"))
    got = spark.range(1).select(english_stems(F.lit("The licenses of running jobs were indexed nightly is bed"))).first()[0]
    assert got == ["licens", "run", "job", "index", "night", "bed"]


def test_english_stream_matches_any_form(spark):
    docs = spark.createDataFrame([(1, "He lies and lied"), (2, "tying knots"), (3, "A tie, two ties; the running"), (4, None)], "doc_id long, text string")
    ids = lambda q: [r["id"] for r in R.lexical_stream_english(docs, q, 9).collect()]
    assert ids("tied") == [3, 2] and ids("the run ties") == [3] and ids("the of") == [] and ids("lying") == [1]
