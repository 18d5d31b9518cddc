"""License scan, manifest and conversation repair: against SQL, brute force and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reefline.llm import entries, licenses, manifest, q_licenses, q_manifest, q_repair, repair
from tests.compare import same


def test_licenses_against_sql(spark, con, small):
    same(q_licenses.op11_license_scan(spark, small).toPandas(), con.sql(q_licenses.ORACLES["op11_license_scan"]).df())


TEMPLATES = (("a", "one [[two {{x:1-3}}]] three four"), ("b", "{{y:one two|five}} three [[six [[seven]]]] four"), ("c", "[[zero {{z:1-2}} is]] {{w:one|three|four four}} two two"))


def test_licenses_against_regular_expressions(spark):
    rng = random.Random(4)
    words = "zero one two three four five six seven is other".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None, "one", "ONE, two; x\ny z three-four"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TEMPLATES, (("p", "two two"),)).collect()
    seen = set()
    for r in rows:
        w = licenses.words_of(texts[r.doc_id] or "")
        assert r.n_words == len(w)
        for label, t in TEMPLATES:
            found = [m for m in r.matches if m.label == label]
            joined = "".join(f"{x} " for x in w)
            assert bool(found) == bool(re.search(licenses.pattern(t), joined)), (label, joined)
            for m in found:  # what is named as a match is one
                assert re.fullmatch(licenses.pattern(t), "".join(f"{x} " for x in w[m.first : m.stop]))
                seen.add(label)
            assert all(a.stop <= b.first for a, b in itertools.pairwise(found))
        assert [m.first for m in r.matches if m.phrase] == [i for i in range(len(w) - 1) if w[i : i + 2] == ["two", "two"]]
    assert seen == {"a", "b", "c"}


def test_licenses_of_whole_texts(spark):
    of = dict(licenses.TEMPLATES)
    plain = lambda t: re.sub(r"\[\[|\]\]", "", re.sub(r"\{\{\w+:(?:\d+-\d+|([^}|]*)[^}]*)\}\}", lambda m: m[1] or "Jane Doe", t))
    texts = {k: plain(of[k]) for k in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-3.0-or-later", "unlicense")}
    texts["changed"] = texts["mit"].replace("without restriction", "with some restriction")
    rows = {r.doc_id: r for r in licenses.verdicts(licenses.scan(spark.createDataFrame([(k, f"Some words before.\n{t}\nand after") for k, t in texts.items()], "doc_id string, text string"))).collect()}
    for k in of:
        if k in rows:
            assert k in rows[k].labels.split(",") and rows[k].score == 1, k
    assert "mit" in rows["changed"].base_labels or rows["changed"].score <= 0.5


@pytest.mark.parametrize("bad", ["one", "{{x:1-2}} one two", "one two {{x:1-2}}", "one two [[three {{x:1-2}}]]", "[[{{x:1-2}} a]] one two", "one [[two", "one ]] two three"])
def test_licenses_refuse_templates(bad):
    with pytest.raises(ValueError):
        licenses.Automaton((("x", bad),), ())


def test_licenses_on_odd_tables(docs, none):
    rows = licenses.verdicts(licenses.scan(docs)).collect()
    assert len(rows) == docs.count() and all(r.labels == "" and r.first_word is None for r in rows)
    assert licenses.verdicts(licenses.scan(none)).count() == 0


def test_manifest_against_sql(spark, con, small):
    same(q_manifest.op12_merkle_manifest(spark, small).toPandas(), con.sql(q_manifest.ORACLES["op12_merkle_manifest"]).df())


H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def _tree(nodes, fanout):
    """Root, and for each node its siblings level by level."""
    own, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(own):
            first = at // fanout * fanout
            proofs[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
            own[k] = at // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(2, 0, [11, 1, 2, 6]), (2, 1, [13, 5, 1]), (3, 1, [29, 3, 4, 10, 1]), (2, 2, [33]), (4, 9, [70, 2])])
def test_manifest_against_brute_force(spark, fanout, levels, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.choice([None, k, k, k // 3]), rng.choice(["s", None]), [None, "", "b", "é", "zz"][j], rng.choice([None, k]), rng.choice(["é x", "", None, "same"])) for j, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS leaf", "2 AS g", "3 AS one").repartition(3)
    got = manifest.audit(manifest.build(docs, q_manifest.tampered, fanout, levels)).collect()
    trees = []
    for lang in sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode())):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((own, *_tree([_leaf(r) for r in own], fanout)))
    root, tops = _tree([t[1] for t in trees], fanout)
    want = []
    for (own, sub, proofs), top in zip(trees, tops, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = _leaf((*r[:3], r[3] + 1, r[4]) if hit else r)
            for left, right in proof + top:
                cur = H(left, cur, right)
            want.append((r[0], _leaf(r), sub, root, H(*[x + y for x, y in proof + top]), cur, cur == root))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r.verified for r in got)


def test_manifest_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.audit(manifest.build(docs)).count() == 0


def test_repair_against_sql(spark, con, small):
    same(q_repair.op13_conversation_repair(spark, small).toPandas(), con.sql(q_repair.ORACLES["op13_conversation_repair"]).df())


def _repaired(rows):
    """Faults, and the cheapest edits by trying every list of edits as they come (rows in order)."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    nothing = (10**9, "", ())
    known = {}

    def best(i, roles):
        """Cost, audit and rows from row i on, where the roles so far end in state ``roles``."""
        if (i, roles) in known:
            return known[i, roles]
        found = [(0, "", ())] if i == len(rows) and roles[:1] in ("", "a") else []
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[roles[:1]]
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[:1]]
        name = {"u": "user", "a": "assistant"}[due]
        if not roles.endswith("!!"):  # two insertions in a row are enough to reach any state
            c, a, r = best(i, due + "!" * (roles.count("!") + 1)) if (i < len(rows) or roles[:1] not in ("", "a")) else nothing
            found.append((c + 2, "I" + a, (f"{name}:", *r)))
        if i < len(rows):
            (role, text), cut = rows[i], faults[i] == "t"
            c, a, r = best(i + 1, roles[:1])
            found.append((c + 3, "D" + a, r))
            if faults[i] not in ("b", "d"):
                if role[:1] in after:
                    c, a, r = best(i + 1, after[role[:1]])
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *r)))
                c, a, r = best(i + 1, due)
                found.append((c + 2 + cut, "R" + a, (f"{name}:{text}", *r)))
        known[i, roles] = min(found, default=nothing)
        return known[i, roles]

    cost, audit, said = best(0, "")
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    return [faults.count(x) for x in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H("\n".join(said))


@pytest.mark.parametrize("block", [256, 2])
def test_repair_against_brute_force(spark, monkeypatch, block):
    """With blocks of two rows and more, conversations are cut at checkpoints."""
    monkeypatch.setattr(repair, "LEAST_BLOCK", block)
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "s", "", None]
    rows = [(rng.choice([c, c, None]) if c == 3 else c, k if rng.random() < 0.8 else rng.choice([None, 2, 5]), rng.choice(roles[: rng.choice([3, 5, 9])]), rng.choice(["hm. ", "and so", "yes!", "", None, " \n", "é?", "x1.", f"t{k}."])) for c in range(40) for k in range(rng.choice([1, 2, 3, 6, 14, 40]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS g", "2 AS block", "3 AS state")
    got = repair.repair(df).collect()
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, " " if role is None else role, H(" " if text is None else text), " " if text is None else text))
    assert sorted((r.conv_id is not None, r.conv_id or 0) for r in got) == sorted((c is not None, c or 0) for c in by)
    for r in got:
        own = sorted(by[r.conv_id])
        faults, illegal, cost, audit, said = _repaired([(x[2], x[4]) for x in own])
        turns = {x[1] for x in own if x[0]}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert ([r.blank, r.duplicate, r.truncated], r.illegal, r.cost, r.audit, r.repaired_sha256) == (faults, illegal, cost, audit, said), own
        assert re.fullmatch("[DIKR]*", r.audit)


def test_repair_of_one_long_conversation(spark):
    """A third of all rows in one conversation: cut into blocks, the same as in one piece."""
    long = spark.range(3000).selectExpr("7 AS conv_id", "id AS turn", "element_at(array('user', 'assistant', 'user', 'assistant', 'tool', 'system'), CAST(pmod(xxhash64(id), 6) + 1 AS int)) AS role", "CASE WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN 'same.' ELSE concat(id, IF(id % 3 = 0, '', '.')) END AS text")
    r = repair.repair(long.withColumn("conv_id", F.lit(7).cast("long"))).first()
    rows = [(x.role, x.text) for x in long.orderBy("turn").collect()]
    codes, seen = [], set()
    for role, text in rows:
        kill = not text or (role, text) in seen
        seen.add((role, text))
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[0], 0) + 4 * kill + 8 * (not kill and text[-1] != "."))
    import numpy as np

    table = np.array([codes])
    v = repair.backward(table, np.array([3000]), repair.END[None, :], True)
    _, (edits,) = repair.forward(table, np.array([3000]), v, np.array([0]), np.array([True]))
    assert (r.cost, r.audit) == (int(v[0, 0, 0]), edits.decode())


def test_repair_of_an_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_new_queries_are_registered():
    assert {"op11_license_scan", "op12_merkle_manifest", "op13_conversation_repair"} <= set(entries.queries()) & set(entries.oracle_sql())
