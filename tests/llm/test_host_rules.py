"""Operator 6 against plain Python."""

import re

from cases import TEXTS, awkward, empty
from compare import difference

from wavelead.llm.host_rules import DEFAULT_STRENGTH, beta_prior, host_verdicts, judge


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    places = {}
    for k, w in enumerate(windows):
        places.setdefault(w, []).append(k)
    repeated = {k + d for ks in places.values() if len(ks) > 1 for k in ks for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    }


def test_query_equals_sql(spark):
    assert difference(spark, "/root/testdata/sf0.001", "op6_host_rules") is None


def test_awkward_texts(spark):
    rows = judge(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = {k: t for k, t in enumerate(TEXTS) if k != 3} | {None: TEXTS[3]}
    for row in rows:
        want = expected(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want
    assert judge(empty(spark)).count() == 0


def test_hosts_are_shrunk(spark):
    rows = [("bad", True)] * 40 + [("good", False)] * 400 + [("one", True)] + [(None, False)] * 3
    hosts = {r["host"]: r for r in host_verdicts(spark.createDataFrame(rows, "h string, f boolean"), "h", "f").collect()}
    rates = [1.0, 0.0, 1.0, 0.0]
    mean = sum(rates) / 4
    assert beta_prior(mean, 0.25) == (0.5, DEFAULT_STRENGTH)
    assert hosts["bad"]["host_rejected"] and not hosts["good"]["host_rejected"] and not hosts[None]["host_rejected"]
    assert abs(hosts["one"]["shrunk_rate"] - (1 + 0.5 * DEFAULT_STRENGTH) / (1 + DEFAULT_STRENGTH)) < 1e-12
