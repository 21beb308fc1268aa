import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from sparkqueue.llm import common
from sparkqueue.llm.mixing import ADDED, OTHER, Mix, leaf_budgets, mixed, share_out
from sparkqueue.llm.queries import MIX

SMALL = Mix(domains={"a": 3, "b": 1}, domain_of={"src0": "a", "src1": "b"}, languages={"en": 2, "de": 1}, sources={"src0": 1, "src1": 1}, epochs=3, share=(3, 2))


def poured(budget, children):
    """Water filling by rounds: whoever is full drops out, and the rest is shared anew."""
    full, left = {}, {n: (w, m) for n, w, m in children}
    while True:
        rest, weights = budget - sum(full.values()), sum(w for w, _ in left.values())
        over = [n for n, (w, m) in left.items() if m <= Fraction(rest * w, weights)]
        if not over:
            return full | {n: rest * w // weights for n, (w, _) in left.items()}
        for n in over:
            full[n] = left.pop(n)[1]
        if not left:
            return full


def test_share_out():
    r = random.Random(0)
    for _ in range(500):
        children = [(f"c{i}", r.randrange(1, 6), r.randrange(0, 400)) for i in range(r.randrange(1, 6))]
        budget = r.randrange(0, 900)
        got = share_out(budget, children)
        assert got == poured(budget, children)
        assert sum(got.values()) <= budget and sum(got.values()) > min(budget, sum(m for *_, m in children)) - len(children)


def test_shortages_go_to_siblings_before_ancestors():
    tokens = {("a", "en", "src0"): 10, ("a", "en", "src1"): 1000, ("a", "de", "src0"): 1000, ("b", "en", "src1"): 1000}
    mix = Mix(domains={"a": 1, "b": 1}, domain_of={}, languages={}, sources={}, total_tokens=800, epochs=1)
    got = leaf_budgets(tokens, mix)
    assert got == {("a", "en", "src0"): 10, ("a", "en", "src1"): 190, ("a", "de", "src0"): 200, ("b", "en", "src1"): 400}


def brute_force(rows, mix):
    leaf, tokens, total = {}, {}, defaultdict(int)
    for k, r in enumerate(rows):
        leaf[k] = (mix.domain_of.get(r.source, OTHER), r.lang if r.lang in mix.languages else OTHER, r.source if r.source in mix.sources else OTHER)
        tokens[k] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        total[leaf[k]] += tokens[k]
    out = []
    for own, budget in leaf_budgets({k: n for k, n in total.items() if n}, mix).items():
        epoch = 0
        while budget > 0:
            order = defaultdict(list)
            for k in leaf:
                if leaf[k] == own:
                    order[hashlib.md5(f"{mix.seed}:{epoch}:{'' if rows[k].doc_id is None else rows[k].doc_id}".encode()).hexdigest()].append(k)
            for key in sorted(order):
                if budget > 0 or epoch < 0:
                    out += [(rows[k].doc_id, *own, tokens[k], epoch) for k in order[key]]
                    budget -= sum(tokens[k] for k in order[key])
            epoch += 1
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("which, mix", [("awkward", SMALL), ("sample", SMALL), ("sample", MIX)])
def test_against_brute_force(request, which, mix):
    docs = request.getfixturevalue(which)
    added = common.free_names(docs, *ADDED)
    got = [(r.doc_id, *(r[c] for c in added)) for r in mixed(docs, mix).collect()]
    expected = brute_force(docs.collect(), mix)
    if which == "awkward":  # rows without words come or go with the keys around them
        got, expected = ([r for r in x if r[4]] for x in (got, expected))
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_columns_stay_and_no_rows(awkward, no_rows):
    assert mixed(awkward, SMALL).columns[: len(awkward.columns)] == awkward.columns
    assert mixed(no_rows, SMALL).count() == 0
    assert mixed(awkward.select("doc_id", "text"), SMALL).select("_domain").distinct().collect()[0][0] == OTHER


def test_tokens_of_another_column(spark):
    rows = [(i, f"word {i}", "en", "src0", None if i == 3 else 10 * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, counted int")
    got = mixed(docs, SMALL, tokens="counted").collect()
    every = sum(r[4] or 0 for r in rows)
    assert sum(r._tokens for r in got) >= every * 3 // 2 and all(r._tokens == (r.counted or 0) for r in got)
    assert sum(r._tokens for r in got) < every * 3 // 2 + 400
