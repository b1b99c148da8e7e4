import random
import textwrap
from collections import Counter

import numpy as np

from lodestone.llm import licenses, rules

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rows, labels = [], []
    for k in range(600):
        words = [f"w{(k * 37 + j * 11) % 1000}" for j in range(12 + k % 40)]
        if k % 4 == 0:
            words = [w + "##" for w in words]
        elif k % 4 == 1 and k % 8 == 1:
            words = [w.upper() for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not (k % 4 == 0 or k % 8 == 1)), 0))
    return rows, labels


def test_rules_learn_what_marks_bad_documents(spark, documents):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "one two"), (1003, "a b c d e " * 10), (1003, "a b c d e " * 10), (1004, "long %d " * 20000)]
    got = rules.judge(documents(rows + odd, extra=True), spark.createDataFrame(labels + [(3, None, None), (9999, 0, 0)], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    wrong = sum(r["kept"] != bool(labels[r["doc_id"]][1]) for r in got if r["doc_id"] < 600)
    assert wrong <= 6
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_list_is_one_ordered_expression(spark):
    x = np.zeros((400, len(rules.RATIOS)))
    x[:, 0], x[:100, 2] = np.arange(400), 0.9
    found = rules.learn(x, np.arange(400) < 100)
    assert len(found) == 1 and str(found[0][0]).startswith(("symbols_per_word > 0.45", "words <="))
    assert "CASE WHEN" in str(rules.verdict(found)) and rules.learn(x, np.zeros(400, bool)) == []


def test_without_labels_only_the_base_rule_holds(spark, documents):
    got = rules.judge(documents([(1, "a b c d e f g h i j ###"), (2, "short")]), spark.createDataFrame([], LABELS)).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: True, 2: False}
    assert rules.judge(documents([]), spark.createDataFrame([], LABELS)).count() == 0


def test_common_is_the_longest_common_subsequence():
    draw = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(map(str, draw.integers(0, 4, draw.integers(0, 12)))) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert licenses.common(a, b) == best[-1, -1]


def test_every_template_is_found_again_among_other_text(documents):
    rows = [(k, f"Some text before.\n\n\nCopyright (c) 2021 A. Holder\n{t}\n\n\nAnd after.") for k, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.scan(documents(rows, extra=True)).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(r["license"])
    for k, name in enumerate(licenses.TEMPLATES):
        assert name in found[k], name
    assert all(rows[r["doc_id"]][1][r["start"] : r["end"]].strip() for r in got)


def test_variants_unknown_and_edges(documents):
    mit = licenses.TEMPLATES["MIT"].replace("without limitation", "with no limitation")
    rows = [(1, mit), (2, "Our license is secret and unlike any other."), (3, None), (4, ""), (5, "nothing here"), (6, "MIT"), (7, "Licensed under CC BY 4.0.\nx\nx\nx\nx\nLicensed under CC BY-NC 4.0."), (8, "word " * 60000 + "\nAll rights reserved.")]
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(documents(rows)).collect()]
    assert sorted(got) == [(1, "MIT"), (2, "unknown"), (7, "CC-BY-4.0"), (7, "CC-BY-NC-4.0"), (8, "Reserved")]
    assert licenses.scan(documents([])).count() == 0


def test_wrapped_notices_are_found_whole(documents):
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense", "Reserved"]
    rows = []
    for name in names:
        text = licenses.TEMPLATES[name].replace("conditions: The", "conditions:\n\nThe").replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. ")
        for mark, width in (("", 72), ("# ", 76), (" * ", 80), ("", 50)):
            lines = [mark + x for part in text.split("\n") for x in textwrap.wrap(part, width) or [""]]
            rows.append((len(rows), f"Some text before.\n\n\n\n{'\n'.join(lines)}\n\n\n\nAnd after.", name))
    got = {}
    for r in licenses.scan(documents([r[:2] for r in rows])).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["n_missing"], rows[r["doc_id"]][1][r["start"] : r["end"]]))
    for k, text, name in rows:
        found = licenses.wording(text)[3:-2]
        assert [(n, m, licenses.wording(t)) for n, m, t in got[k]] == [(name, 0, found)], (name, got[k])


def test_differences_are_the_exact_words(documents):
    """Against a plain alignment: the rows of a table of longest common subsequences."""
    text = licenses.TEMPLATES["MIT"].replace("without limitation", "with no limitation").replace("merge, ", "")
    rows = [(1, text), (1, text), (2, "Licensed under the terms of the MIT License.")]
    got = licenses.scan(documents(rows)).collect()
    mit = [(r["missing"], r["more"], r["n_missing"], r["n_more"]) for r in got if r["license"] == "MIT"]
    assert mit == [("without merge", "with no", 2, 2)] * 2
    assert [(r["license"], r["missing"], r["more"]) for r in got if r["doc_id"] == 2] == [("MIT-licensed", "", "terms of the")]
    draw = random.Random(3)
    for name in ("MIT", "BSD-2-Clause", "ISC"):
        own = licenses.wording(licenses.TEMPLATES[name])
        other = [w for w in own if draw.random() > 0.05]
        other.insert(draw.randrange(len(other)), "zebra")
        missing, more = licenses.Wording(own).differences(other)
        assert more == ["zebra"] and sorted(missing) == sorted((Counter(own) - Counter(other)).elements())


def test_every_notice_of_a_block_is_reported(documents):
    t = licenses.TEMPLATES
    short = ["MIT-licensed", "Apache-2.0-notice", "BSD-notice", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0-notice", "GPL-3.0-notice", "BSL-1.0", "Reserved"]
    cases = [
        ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0-notice", "MIT-notice"]),
        ("Licensed under the MIT or the Apache License, Version 2.0.", ["Apache-2.0-notice", "MIT-licensed"]),
        ("\n".join(t[k] for k in short), short),
        ("\n".join(f"Copyright of part {k}: {t['MIT']}\n{t['BSD-3-Clause']}" for k in range(3)) + "\n" + t["Reserved"], ["MIT", "BSD-3-Clause"] * 3 + ["Reserved"]),
        ("license text " * 700 + t["CC-BY-4.0"] + " license text" * 700, ["CC-BY-4.0"]),
        (t["MIT"].replace("conditions:", "conditions: " + "license of no one " * 60), ["unknown"]),  # interrupted by more words than a notice may have
        ("all the text here shows no rights of any other people and some seats are reserved, copyright", ["unknown"]),
        ("MIT License or Apache License 2.0, all rights reserved", ["MIT-name", "Apache-2.0-name", "Reserved"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["unknown"]),
        ("SPDX-License-Identifier: MIT", ["SPDX-MIT"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["SPDX-MIT", "SPDX-Apache-2.0"]),
        (t["MIT"] + "\n\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0-notice"]),
        ("word " * 3000 + t["MIT"].replace(" ", "\n") + " word" * 3000, ["MIT"]),
    ]
    got = {k: [] for k in range(len(cases))}
    for r in licenses.scan(documents([c[0] for c in cases])).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["license"]))
    for k, (text, names) in enumerate(cases):
        assert sorted(x[2] for x in got[k]) == sorted(names), (names, got[k])
        if len(names) > 3:
            assert [licenses.wording(text[a:b]) for a, b, _ in sorted(got[k])] == [licenses.wording(t[n]) for n in names]


def test_grown_condition_is_the_best_of_all():
    """Against every threshold of every statistic, both ways; ties go to the first statistic, then <=."""
    draw = np.random.default_rng(4)
    for _ in range(40):
        x = draw.integers(0, 5, (30, len(rules.RATIOS))).astype(float)
        bad = draw.random(30) < 0.4
        if not 0 < bad.sum() < 30:
            continue
        best = (1e-9, None)
        for k, name in enumerate(rules.RATIOS):
            values = np.unique(x[:, k])
            for above in (False, True):
                for cut in (values[1:] + values[:-1]) / 2:
                    hit = x[:, k] > cut if above else x[:, k] <= cut
                    p = bad[hit].sum()
                    gain = p * (np.log2(p / hit.sum()) - np.log2(bad.mean())) if p else 0.0
                    if gain > best[0] + 1e-12:
                        best = gain, (name, above)
        got, condition = rules._best(x, bad)
        assert abs(got - best[0]) < 1e-9
        covered = condition.holds(x) if condition else np.zeros(30, bool)
        if condition:
            p = bad[covered].sum()
            assert abs(p * (np.log2(p / covered.sum()) - np.log2(bad.mean())) - got) < 1e-9
        assert (condition is None) == (best[1] is None)


def test_repeated_labelled_ids_are_one_row(spark, documents):
    rows, labels = corpus()
    labels = spark.createDataFrame(labels, LABELS)
    once = [tuple(map(str, r)) for r in rules.fit(documents(rows), labels)]
    again = [tuple(map(str, r)) for r in rules.fit(documents(rows + [rows[0]] * 300), labels)]
    assert once == again


def test_compression_ranks_and_wording_confirms(documents, monkeypatch):
    """The exact template is reported where others have all but one word; without the bytes saved, others come first."""
    t = licenses.TEMPLATES
    names = ["GPL-3.0-notice", "AGPL-3.0-notice", "LGPL-3.0-notice", "BSD-3-Clause", "MIT", "SPDX-GPL-2.0-only", "SPDX-GPL-3.0-or-later", "SPDX-GPL-2.0", "LGPL-2.1-name", "GPL-2.0-short"]
    texts = [t[n] for n in names] + [t["MIT"].replace("publish, ", "")]
    wanted = [[(n, 0)] for n in names] + [[("MIT", 1)]]

    def found():
        got = [[] for _ in texts]
        for k, text in enumerate(texts):
            got[k] = [(r[0], r[4]) for r in licenses.Scanner().scan(text)]
        return got

    assert found() == wanted
    assert [r["license"] for r in licenses.scan(documents([t["SPDX-AGPL-3.0-only"] + " WITH exception"])).collect()] == ["SPDX-AGPL-3.0-only"]
    monkeypatch.setattr(licenses.Scanner, "_sizes", lambda self, name, words: (100, 90))
    assert found() != wanted


def test_spans_are_the_best_windows_by_brute_force():
    """One notice among other words: of all windows that the rules allow, the one with most words matched and fewest more."""
    draw = random.Random(11)
    for _ in range(150):
        own = [draw.choice("abcdef") + str(k % 5) for k in range(draw.randrange(5, 14))]
        w = licenses.Wording(own)
        copy = [x for x in own if draw.random() > 0.06]
        for _ in range(draw.randrange(0, 3)):
            copy.insert(draw.randrange(len(copy) + 1), "zebra")
        words = ["left"] * draw.randrange(0, 5) + copy + ["right"] * draw.randrange(0, 5)
        best = None
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                n = licenses.common(words[a:b], own)
                if n >= w.need and b - a - n <= w.more and w.versions.issubset(words[a:b]):
                    best = max(best or (-99, 0), (2 * n - (b - a), n))
        got = w.spans(words)
        assert [(2 * n - (b - a), n) for a, b, n in got] == ([best] if best else []), (own, words)
