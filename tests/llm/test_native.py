"""Chat windows, the rule ledger and line dedup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reefline.llm import _frames, chat, lines, q_chat, q_lines, q_rules, rules
from tests.compare import same


@pytest.mark.parametrize("module,name", [(q_chat, "op1_chat_format"), (q_rules, "op6_quality_rules"), (q_rules, "rules_ablation"), (q_lines, "op3_line_dedup")])
def test_against_sql(spark, con, small, module, name):
    same(module.QUERIES[name](spark, small).toPandas(), con.sql(module.ORACLES[name]).df())


@pytest.mark.parametrize("module,name", [(q_chat, "op1_chat_format"), (q_rules, "op6_quality_rules"), (q_lines, "op3_line_dedup")])
def test_no_python_in_the_plan(spark, small, module, name):
    plan = module.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


NASTY = ["<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "\\", "\\\\<", "<s>", "</s>", "[INST]", "[/INST]", "<\\|", "\n", "", "é漢\U0001f600", "<", "[", "$1"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 3, 40])):
            rows.append((c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "<|im_sep|>odd\nrole"]), "".join(rng.choices(NASTY, k=rng.randint(0, 30))) + "word " * rng.randint(0, 80)))
    rows += [(50, 0, None, None), (50, 0, "assistant", None), (None, None, "assistant", "x"), (51, 1, "user", "same"), (51, 1, "user", "same"), (52, 0, "assistant", "long " * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.windows(turns, stride=200, history=2, history_tokens=100).cache()
    back = chat.read_back(made).select("conv_id", F.explode("turns").alias("t")).orderBy("conv_id", "t.turn_no").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = [(r[0], r[2] or "", r[3] or "") for r in sorted(rows, key=key)]
    assert [(r.conv_id, r.t.role, r.t.text) for r in back] == want
    for r in back:
        assert r.t.target == (r.t.text if r.t.role == "assistant" else None)
    for w in made.collect():
        fresh = [s for s in w.segments if s.fresh]
        assert len(fresh) == 1 or sum(s.length for s in fresh) < 200 * 40
        assert all(s.fresh for s in w.segments if s.loss)
        marks = re.sub(r"\\.", "", w.formatted, flags=re.S)
        assert marks.count("<|im_start|>") == marks.count("<|im_end|>") == len(w.segments)
    assert chat.windows(turns.limit(0)).count() == 0


def _brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {p for i, g in enumerate(tri) if tri.count(g) > 1 for p in (i, i + 1, i + 2)}
    ls = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(again)


def test_ledger_against_brute_force(spark, docs, none):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "# ", "\t", "dd  ", "é\x0b", "\n\n", "!"], k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "x y z " * 50]
    rows = rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute(texts[r.doc_id])
    assert rules.ledger(docs).count() == docs.count() and rules.ledger(none).count() == 0
    kept = rules.apply_policy(rules.ledger(docs), rules.STRICT)
    assert kept.where("kept").count() == kept.where("failed = 0").count()
    assert kept.where("kept").select("n_repeat_words").count() == 0  # moved filters stay cheap and right


def test_ablations(spark):
    rows = spark.createDataFrame([(1,), (3,), (2,), (2,), (0,), (64,)], "failed long")
    got = {r.rule: (r.failed, r.only_this) for r in rules.ablations(rows, rules.BASE).collect()}
    assert got == {"few_words": (2, 1), "repeated_words": (3, 2)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton(spark, edits):
    rng = random.Random(edits)
    pairs = [("".join(rng.choices("ab\U0001f600", k=rng.randint(0, 9))), "".join(rng.choices("ab\U0001f600", k=rng.randint(0, 9)))) for _ in range(250)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("near"))
    for r in df.collect():
        assert r.near == (_distance(r.a, r.b) <= edits), (r.a, r.b)


def _dedupe(rows):
    """Texts after the removal, by the definition."""
    seen, out = [], {}
    for i, text in sorted(rows):
        for p, x in enumerate(text.split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                seen.append((i, p, x))
    first = {}
    for i, p, x in seen:
        first.setdefault(x, (i, p))
    long_ = [x for x in first if len(x.strip(" \t\n\x0b\x0c\r")) >= lines.MIN_CHARS]
    late = {x for x in long_ if any(first[y] < first[x] and abs(len(x) - len(y)) <= 1 and _distance(x, y) <= 1 for y in long_)}
    for i, text in rows:
        out[i] = "\n".join(x for p, x in enumerate(text.split("\n")) if not x.strip(" \t\n\x0b\x0c\r") or x not in late and first[x] == (i, p))
    return out


@pytest.mark.parametrize("hot", [256, 3])
def test_line_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(7)
    base = ["the quick brown fox jumps over it", "é" * 25, "a much longer line of text that is shared by a lot of documents here"]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 4)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(x))
                x[k : k + rng.choice([0, 1])] = rng.choice(["", "z", "Y", "q"])
            text.append("".join(x))
        rows.append((i, "\n".join([*text, "short", ""])))
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _dedupe(rows)


@pytest.mark.parametrize("length", [40, 64])
def test_two_letters_for_one_in_frequent_keys(spark, monkeypatch, length):
    monkeypatch.setattr(lines, "HOT", 3)
    left, right = "the left side of it ", "x" * (length - 21)
    doubled = [x + y for x in "abcdef" for y in "abcdef"]
    middle = [*sorted(doubled, key=lambda m: m[0] != m[1]), "a"]  # 'aa', 'bb', ... are two edits apart and come first
    rows = [(i, left + m + right) for i, m in enumerate(middle)]
    want = _dedupe(rows)
    assert sum(x != "" for x in want.values()) == 6
    for some in (rows, [(-i, text) for i, text in rows]):
        got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got == _dedupe(some)


def test_frequent_keys_of_lines_two_edits_apart(spark):
    """More than HOT lines with one head and tail: letters in the middle, all of them two edits from each other."""
    head, tail = "the same head of each line, over thirty letters ", " the same tail of each line, over thirty letters"
    rows = [(i, head + chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) + tail) for i in range(300)] + [(300, head + "z" + tail)]
    assert len(rows) > lines.HOT
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_latin_grid_of_frequent_keys(spark):
    head, tail = "a head of the line that all share ", " and a tail that all of them share too"
    letters = "abcdefghijklmnopqrst"
    rows = [(i, head + letters[i % 20] + letters[(i // 20 * 7 + i) % 20] + tail) for i in range(400)]
    assert len(rows) > lines.HOT
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, want = {}, {}
    for i, text in rows:  # of a grid, only lines of the same first or second letter are within one edit
        code = text[len(head) : len(head) + 2]
        want[i] = text if not any((a == code[0]) != (b == code[1]) or code == a + b for a, b in first) else ""
        first[code] = i
    assert got == want


def test_ids_of_any_type_and_frequent_short_lines(spark, monkeypatch):
    monkeypatch.setattr(_frames, "TOGETHER", 5)
    rows = [("b", "end\na line that is long enough to be compared\n "), ("a", "end\nend\n \na line that is long enough to be compared"), (None, "end\nEnd\na line that is long enough to be compareD")] + [(f"c{k}", "end\nx") for k in range(20)]
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "end\n \na line that is long enough to be compared", "b": " ", None: "End", "c0": "x", **{f"c{k}": "" for k in range(1, 20)}}


def test_line_dedup_edges(spark, docs, none):
    out = lines.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert (3, None) in rows and (2, "") in rows and (1, "one two three four five six seven") in rows and rows.count((4, "")) == 2
    assert {(r._h, r.h1) for r in out.collect()} == {(4, 5)}
    assert lines.deduplicate(none).count() == 0
