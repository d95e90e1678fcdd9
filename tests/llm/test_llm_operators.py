"""Operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweb.llm import decontamination, line_dedup, mixing, near_dedup, quality, quality_rules, sharding, substring_dedup, token_counts, url_filter
from strataweb.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\n ", "a", "a a a a a a a a a a a a", "x y\nx y\n\n  \n  \nx y\r\nz\x0bq", "é è é è é è é è é è é è é è é è é è é è é"]
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed=None):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.08 else "") + ("\n" if r.random() < 0.04 else "") for _ in range(n))


def docs(spark, rows, extra=()):
    full = [(*r, *(None,) * (5 - len(r))) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and repeated rows, and one long text."""
    long = prose(30_000, 1)
    rows = [(k, t, "en", "s1") for k, t in enumerate(ODD)] + [(None, "null id", None, None), (7, prose(60, 2)), (7, prose(60, 2)), (8, long, "fr", "s2"), (9, prose(60, 2), None, "s1")]
    return docs(spark, rows)


ADDS = ["size", "shard", "slot", "block", "position", "score", "predicted", "n_words", "kept", "removed", "items", "spans", "label", "node", "near_id", "kept_id", "host", "path", "verdict", "rule", "n_tokens", "leaf_tokens", "url"]
OPERATORS = {
    "shard": lambda d, s: sharding.shard(d, 4),
    "mix": lambda d, s: mixing.mix(d),
    "mixed_order": lambda d, s: mixing.in_mixed_order(d, block=2),
    "scan": lambda d, s: decontamination.scan(d, s.createDataFrame([(1, "null id"), (2, None), (None, "x")], "item_id long, text string")),
    "rules": lambda d, s: quality_rules.judge(d),
    "near": lambda d, s: near_dedup.near_duplicates(d),
    "lines": lambda d, s: line_dedup.report(d),
    "substrings": lambda d, s: substring_dedup.deduplicate(d),
    "tokens": lambda d, s: token_counts.count(d),
    "edits": lambda d, s: token_counts.apply_edits(token_counts.count(d).withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,replacement:string>>"))),
    "urls": lambda d, s: url_filter.judge(d.withColumn("url", F.col("text"))),
    "cut_lines": lambda d, s: line_dedup.deduplicate(d),
    "quality": lambda d, s: quality.score(d, quality.fit(d, s.createDataFrame([(7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_are_all_kept(spark, odd, name):
    assert OPERATORS[name](odd, spark).count() == odd.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_and_empty_tables(spark, odd, name):
    clashing = docs(spark, [(1, prose(40, 3), "en", "a"), (2, None, None, None)], ADDS)
    assert OPERATORS[name](clashing, spark).count() == 2
    assert OPERATORS[name](odd.limit(0), spark).count() == 0


def test_keep_one_row_of_each_class(spark, odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is not None, x)) == [None, 0, 2, 3, 4, 5, 6, 7, 8]  # null equals empty; 7 and 9 are copies


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for base in range(12):
        words = prose(120, 100 + base).split()
        for copy in range(9):
            edited = [r.choice(VOCABULARY) if r.random() < copy * 0.004 else w for w in words]
            rows.append((len(rows), " ".join(edited)))
    found = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}

    idf = near_dedup.idf_of_texts([t for _, t in rows])
    bags = []
    for _, t in rows:
        _, grams, weight = near_dedup.shingles(pa.array([t]), idf)
        bags.append(dict(zip(grams.tolist(), weight.tolist(), strict=True)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w, bags[j][g]) for g, w in bags[i].items() if g in bags[j])
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= near_dedup.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    wanted = {i: root(i) for i in range(len(rows))}
    assert sum(found[i] == wanted[i] for i in wanted) / len(wanted) > 0.98  # sampling may miss a link


def test_word_weights_are_those_of_exact_counts(spark):
    r = random.Random(31)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(r.randint(0, 40))) for _ in range(1500)] + [None, "", "..."]
    idf = near_dedup.document_frequencies(docs(spark, list(enumerate(texts))))
    held = [set((t or "").split()) & {w for w in (t or "").split() if w != "..."} for t in texts]
    n, df = sum(len(h) > 0 for h in held), defaultdict(int)
    for h in held:
        for w in h:
            df[w] += 1
    words = sorted(df)
    hashes, _ = near_dedup._words(pa.array(words))
    wanted = [1 + min(np.log(df[w] / n) / np.log(near_dedup.RARE), 1) for w in words]
    assert idf(hashes) == pytest.approx(wanted, abs=1e-9) and len(set(wanted)) > 20
    assert len(idf.more_ids) > 0 and idf(near_dedup._words(pa.array(["unheard"]))[0]).tolist() == [2]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_keep_one_of_each_component(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest"
    typo = line.replace("lazy", "lazi")
    other = "completely different words stand here in order to be left alone by the operator under test"
    rows = [(1, f"{line}\n{other}"), (2, f"short\n{typo}\nRe."), (3, f"{line.upper()}!\nnew text that is long enough to count as a line here"), (4, f"{other}\n{other}")]
    found = {r["doc_id"]: [(s["start"], s["end"], s["first_doc_id"]) for s in r["removed"]] for r in line_dedup.report(docs(spark, rows)).collect()}
    assert found == {1: [], 2: [(6, 6 + len(typo) + 1, 1)], 3: [(0, len(line) + 2, 1)], 4: [(0, len(other) + 1, 1), (len(other) + 1, 2 * len(other) + 1, 1)]}


def test_substrings_against_brute_force(spark):
    passage = prose(70, 77)
    rows = [(k, "\n".join([prose(30, 200 + k), passage if k % 3 == 0 else prose(20, 300 + k), prose(15, 400 + k)])) for k in range(12)]
    seen, wanted = {}, {}
    for k, text in rows:
        gone = set()
        for m in re.finditer(r"[^\n]+", text):
            pieces = [(m.start(), m.end())]
            cuts = [m.start()] + [c.end() for c in re.finditer(r"[.!?] ", m.group()) for c in [type("P", (), {"end": staticmethod(lambda c=c, m=m: m.start() + c.end())})]] + [m.end() + 1]
            pieces += [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
            for a, b in pieces:
                key = tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text[a:b].lower()))
                if len(key) >= substring_dedup.MIN_WORDS:
                    if key in seen and seen[key] != (k, a):
                        gone.add((a, min(b + 1, len(text))))
                    seen.setdefault(key, (k, a))
        wanted[k] = gone
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["removed"]} for r in substring_dedup.deduplicate(docs(spark, rows), min_run=0).collect()}
    covered = {k: {i for a, b in v for i in range(a, b)} for k, v in found.items()}
    assert covered == {k: {i for a, b in v for i in range(a, b)} for k, v in wanted.items()}
    assert any(covered.values())


@pytest.mark.parametrize("between", [" ", "&&& ", "\t", ".\" ", "\u201d ", "\u00bb\u00a0", " (", "\u2026 \u201c", "%%% -- ", ".. "])
def test_stops_with_marks_behind_them_end_sentences(spark, between):
    said = [" ".join(f"w{k}{c}" for k in range(6)) for c in "abcd"]
    rows = [(1, ". ".join(said[:3]) + "."), (2, f"before it.{between}{said[1]}!{between}{said[2]}?{between}after it"), (3, f"{said[3]}.{between}few words")]
    found = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(docs(spark, rows), min_run=12).collect()}
    assert found[1] == rows[0][1] and found[3] == rows[2][1]
    assert all(w not in found[2] for w in f"{said[1]} {said[2]}".split()) and "before it" in found[2] and "after it" in found[2]


def test_null_and_shared_ids_lose_their_repeats(spark):
    passage, other = prose(40, 901).replace("\n", " "), prose(40, 902).replace("\n", " ")
    rows = [(None, f"{passage}\none"), (None, f"{passage}\ntwo"), (5, f"{other}\nthree"), (5, f"{other}\nfour"), (6, f"{other}\n{passage}\nfive"), (6, f"{other}\n{passage}\nfive")]
    found = substring_dedup.deduplicate(docs(spark, rows)).collect()
    texts = [(r["doc_id"], r["text"]) for r in found]
    assert sum(passage in t for i, t in texts if i is None) == 1 and sum(other in t for i, t in texts if i == 5) == 1
    assert [t for i, t in texts if i == 6] == ["five", "five"]
    firsts = {s["first_doc_id"] for r in found if r["doc_id"] == 6 for s in r["removed"]}
    assert firsts == {None, 5}


def test_ids_may_be_texts(spark):
    passage = prose(40, 903).replace("\n", " ")
    rows = spark.createDataFrame([("b", f"{passage}\nx"), ("a", f"y\n{passage}")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(rows).collect()} == {"a": f"y\n{passage}", "b": "x"}


@pytest.mark.parametrize("seed", range(5))
def test_long_runs_equal_brute_force(seed):
    r, spans = random.Random(seed), []
    for row in range(30):
        at = 0
        for _ in range(r.randint(0, 8)):
            at += r.choice([0, 0, 5, substring_dedup.GAP, substring_dedup.GAP + 1, 90])
            n, line = r.randint(1, 3), at
            parts = [(line + 10 * k, line + 10 * k + 10, r.randint(5, 9)) for k in range(n)]
            if r.random() < 0.5:  # a line around its sentences
                spans.append((row, line, line + 10 * n, sum(w for *_, w in parts)))
            spans += [(row, *p) for p in parts]
            at = line + 10 * n
    spans = sorted(set(spans), key=lambda s: (s[0], s[1], -s[2]))
    runs, of = [], {}
    for s in spans:
        top = runs[-1] if runs else None
        if not top or top[0] != s[0] or s[1] > top[1] + substring_dedup.GAP:
            runs.append([s[0], s[2], s[3]])
        elif s[1] >= top[1]:
            top[1], top[2] = s[2], top[2] + s[3]
        of[s] = len(runs) - 1
    wanted = [runs[of[s]][2] >= 20 for s in spans]
    found = substring_dedup.in_long_runs(*(np.array([s[k] for s in spans]) for k in range(4)), 20)
    assert found.tolist() == wanted and any(wanted) and not all(wanted)


def sentence_ends(line, is_mark):
    """Where the sentences of a line end, by looking at each run of marks."""
    ends = []
    for run in re.finditer("m+", "".join("m" if is_mark(c) else "w" for c in line)):
        marks = line[run.start() : run.end()]
        stop = next((k for k, c in enumerate(marks) if c in ".!?\u3002\uff01"), None)
        if stop is None:
            continue
        space = next((k for k in range(stop, len(marks)) if marks[k].isspace()), None)
        if space is not None:
            ends.append(run.start() + space + 1)
        elif re.search("[\u3002\uff01]", marks):
            ends.append(run.end())
    return ends


def test_units_equal_brute_force_on_marks_and_wide_text():
    r = random.Random(4)
    parts = [". ", "! ", "?\t", ".", "\u3002", "\uff01\u300d", "\u3002\u3000", "\n", " ", "\u00ab", "\u201d", "& ", ".&& ", "ab", "Cd", "é", "\U0001f600", "漢字仮名", "かな", " x", " yz", " q", " r", " s"]

    def is_mark(c):
        return not (c.isalnum() or c in "漢字仮名かな")

    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        wanted, at = set(), 0
        for line in text.split("\n"):
            cuts = sorted({0, *sentence_ends(line, is_mark), len(line)})
            for a, b in [(0, len(line)), *zip(cuts, cuts[1:], strict=False)]:
                words = "".join(" " if is_mark(c) else c for c in line[a:b]).split()
                if len(words) >= 3 or len(re.findall("[漢字仮名かな]", line[a:b])) >= 3 * substring_dedup.CHARS:
                    wanted.add((at + a, at + b if b < len(line) else min(at + b + 1, len(text))))
            at += len(line) + 1
        found = substring_dedup.text_units(pa.array([text]), 3)
        found = {(int(a), int(b)) for a, b in zip(found["start"], found["end"], strict=True)}
        # A sentence that ends in white space at a line's end may leave the newline to the line.
        assert {(a, b + (text[b - 1 : b + 1][1:] == "\n" != text[b - 1])) for a, b in found} == wanted, repr(text)


def test_suffix_array_repeats_equal_brute_force():
    texts = [prose(n, n) for n in (0, 5, 30, 200)] + [prose(40, 1) + " " + prose(40, 1), "of " * 60 + "x " * 30, *[t for t in ODD]]
    found = quality_rules.measures(pa.array(texts))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows, covered = defaultdict(list), set()
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        for at in windows.values():
            if len(at) > 1:
                covered |= {p for k in at for p in range(k, k + 8)}
        longest = next(n for n in range(len(words), -1, -1) if n == 0 or len({tuple(words[k : k + n]) for k in range(len(words) - n + 1)}) < len(words) - n + 1)
        assert (found["n_words"][i], found["n_repeat_words"][i], found["longest_repeat"][i]) == (len(words), len(covered), longest)


def test_edited_counts_equal_counts_from_scratch():
    counts, r = token_counts.piece_counts(), random.Random(3)
    parts = ["", " ", "  ", "\n", "a", " the", "'s", "\n\n  ", "é", "123", "x\n", "!!", "'"]
    for _ in range(300):
        text = prose(r.choice([0, 3, 40, 900]), r.random())
        tree = token_counts.TokenTree.of(text, counts)
        for _ in range(3):
            start = r.randint(0, len(text))
            end = start + r.choice([0, 1, 2, 50, 500])
            new = "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
            wanted = text[:start] + new + text[end:]
            text, tree, _ = token_counts.edited(text, tree, start, end, new, counts)
            assert text == wanted and tree.n_chars == len(text)
            assert tree.n_tokens == len(counts.encoding.encode_ordinary(text))


def test_edits_behind_blank_lines_and_apostrophes(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 1)
    counts, r = token_counts.piece_counts(), random.Random(11)
    cases = [("ab.\n\nN", 5, 6, " [revised] "), ("x'r", 3, 3, "e"), ("x'l", 3, 3, "l")]
    parts = ["\n", "\n\n", " ", "  ", "'", "'r", "'v", "l", "e", "N", "ab", ".", "7", "\t", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        start = r.randint(0, len(text))
        cases.append((text, start, start + r.choice([0, 0, 1, 3]), "".join(r.choice(parts) for _ in range(r.randint(0, 2)))))
    for text, start, end, new in cases:
        after, tree, _ = token_counts.edited(text, token_counts.TokenTree.of(text, counts), start, end, new, counts)
        assert tree.n_chars == len(after)
        assert tree.n_tokens == len(counts.encoding.encode_ordinary(after)), (text, start, end, new)


def test_edits_of_a_table(spark):
    edits = spark.createDataFrame([(1, 1, 0, 1, "B"), (1, 2, 1, 1, "!"), (2, 1, 0, 99, "")], "doc_id long, seq int, start int, end int, replacement string")
    counted = token_counts.count(docs(spark, [(1, "a b"), (2, "long text"), (3, "c"), (4, None)]))
    rows = token_counts.apply_edits(token_counts.with_edits(counted, edits)).orderBy("doc_id").collect()
    assert [(r["text"], r["edited_chars"], r["n_tokens"], r["reencoded_chars"] > 0) for r in rows] == [("B! b", 4, len(token_counts.piece_counts().encoding.encode_ordinary("B! b")), True), ("", 0, 0, False), ("c", 1, 1, False), (None, 0, 0, False)]
    assert all(sum(r["leaf_tokens"]) == r["n_tokens"] and sum(r["leaf_chars"]) == r["edited_chars"] for r in rows)


def test_stored_leaves_are_encoded_only_where_edits_touch():
    text, counts = prose(20_000, 5), token_counts.piece_counts()
    whole = token_counts.TokenTree.of(text, counts)

    class Spy(token_counts.PieceCounts):
        seen = 0

        def __init__(self):
            self.pattern = counts.pattern

        def __getitem__(self, piece):
            Spy.seen += len(piece)
            return counts[piece]

    stored = token_counts.TokenTree(np.array(whole.chars.tolist()), np.array(whole.tokens.tolist()))  # as read from a table
    new, tree, again = token_counts.edited(text, stored, 60_000, 60_040, " [revised] ", Spy())
    assert Spy.seen == again < 1500 < len(text) / 50
    assert tree is stored and tree.leaves == whole.leaves  # only sums above the leaf have changed
    assert tree.n_tokens == len(counts.encoding.encode_ordinary(new)) and tree.n_chars == len(new)


def test_token_counts_of_odd_rows(spark, odd):
    rows = token_counts.count(odd).collect()
    encoding = token_counts.piece_counts().encoding
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(r["text"] or "")) == sum(r["leaf_tokens"]) for r in rows)
    word = "x" * 200_000 + "\n" + " " * 5000
    assert token_counts.count(docs(spark, [(1, word)])).first()["n_tokens"] == len(encoding.encode_ordinary(word))


def test_schedule_stays_within_one_block(spark):
    rows = [(k, "x", "en", "abcdd"[k % 5] if k < 400 else "d") for k in range(600)]
    weights = {"a": 3, "b": 1, "c": 1}  # d, which they lack, has their mean
    placed = mixing.mix(docs(spark, rows), weights=weights, block=1).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(600))
    shares, seen, size = [3, 1, 1, 5 / 3], defaultdict(int), {"a": 80, "b": 80, "c": 80, "d": 360}
    for turn, r in enumerate(placed, 1):
        seen[r["source"]] += 1
        if any(seen[s] == size[s] for s in "abcd"):
            break
        assert all(abs(seen[s] - turn * shares[k] / sum(shares)) < 1 + 1e-6 for k, s in enumerate("abcd"))


def earliest_deadlines(whole, blocks):
    """(lane, block, slot) of every block by one walk over all slots."""
    total, done, out, slot = sum(whole), [0] * len(whole), [], 0
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        lane = min((-(-(done[i] + 1) * total // w), i) for i, w in enumerate(whole) if done[i] * total // w <= slot)[1]
        if done[lane] < blocks[lane]:
            out.append((lane, done[lane], slot))
        done[lane] += 1
        slot += 1
    return out


# A hot source and small ones with windows longer than a frame; coprime weights; more sources than slots of a frame.
@pytest.mark.parametrize("shares,rows", [([900, *[1] * 7, 0.5], [6000, *[9] * 7, 5]), ([7, 5, 3, 2.5, 0.77], [3001, 2000, 1500, 1111, 400]), ([40, *[1] * 1100], [90, *[2] * 1100])])
def test_schedule_equals_one_walk_and_the_weights(spark, shares, rows):
    whole = mixing.whole_weights(shares)
    found = sorted((r["first"], r["lane"], r["block"], r["slot"]) for r in mixing.schedule(spark, whole, rows, 1).collect())
    assert [x[0] for x in found] == list(range(sum(rows)))
    assert [x[1:] for x in found] == earliest_deadlines(whole, rows)
    seen = np.zeros(len(rows))
    for turn, (_, lane, _, _) in enumerate(found, 1):
        seen[lane] += 1
        if seen[lane] == rows[lane]:
            break
        assert (abs(seen - turn * np.array(shares) / sum(shares)) < 1 + 1e-6).all()  # weights are rounded


def test_mixture_follows_the_weights_themselves(spark):
    sizes = {"hot": 5000, **{f"s{k:02}": 90 for k in range(60)}}
    rows = [(k, "x", "en", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    placed = mixing.mix(docs(spark, rows), block=4).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(len(rows))) and len({r["doc_id"] for r in placed}) == len(rows)
    total, seen = sum(n**0.5 for n in sizes.values()), defaultdict(int)
    for turn, r in enumerate(placed, 1):
        seen[r["source"]] += 1
        if seen[r["source"]] == sizes[r["source"]] // 4 * 4:
            break
        if turn % 4 == 0:
            assert all(abs(seen[s] / 4 - turn / 4 * n**0.5 / total) < 1 for s, n in sizes.items())
    assert turn > 3000


def test_rows_without_an_id_or_of_one_id_are_spread(spark):
    rows = [(None, f"t{k}", "en", "a") for k in range(3000)] + [(7, f"u{k}", "en", "a") for k in range(3000)] + [(k, "same", "en", "b") for k in range(100)]
    d = docs(spark, rows)
    placed = mixing.mix(d, block=4).collect()
    assert sorted(r["position"] for r in placed) == list(range(len(rows)))
    h = F.conv(F.substring(mixing.row_key(d.where("source = 'a'")), 1, 8), 16, 10).cast("long")
    groups = d.where("source = 'a'").groupBy(F.shiftright(h * 3, 32)).count().collect()
    assert len(groups) == 3 and max(r["count"] for r in groups) < 2500


def test_weight_zero_follows_all_others(spark):
    rows = [(k, "x", "en", "zab"[k % 3]) for k in range(300)]
    placed = mixing.mix(docs(spark, rows), weights={"a": 1, "b": 2, "z": 0}, block=7).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(300)) and {r["source"] for r in placed[200:]} == {"z"}
    assert all(a["slot"] <= b["slot"] for a, b in zip(placed, placed[1:], strict=False))


def test_hilbert_neighbours_differ_in_one_step(spark):
    cells = [r["cell"] for r in sharding.hilbert_table(spark, 3, 4).orderBy("curve").collect()]
    points = np.array([[c >> 8, c >> 4 & 15, c & 15] for c in cells])
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all() and len(set(cells)) == 4096


def test_windows_of_short_items_and_case(spark):
    bench = spark.createDataFrame([(1, "Alpha BETA"), (2, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    rows = [(1, "x alpha, beta! y"), (2, "x " + " ".join(f"W{k}" for k in range(11)) + " z"), (3, "alpha gamma beta"), (4, "É " + " ".join(f"w{k}" for k in range(9)))]
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.scan(docs(spark, rows), bench).collect()}
    assert found == {1: (4, 2, ["1"]), 2: (13, 11, ["2"]), 3: (3, 0, []), 4: (10, 0, [])}
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs(spark, rows), bench).orderBy("doc_id").collect()] == [3, 4]


def test_clean_texts_of_a_contaminated_id_stay(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = [(None, "x alpha beta"), (None, "clean"), (None, None), (5, "alpha beta y"), (5, "alpha gamma"), (5, "alpha beta y")]
    kept = decontamination.remove_contaminated(docs(spark, rows), bench).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, "clean"), (None, None), (5, "alpha gamma")], key=str)


def test_contamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "null id"), (2, None), (None, "a"), (3, "")], "item_id long, text string")
    found = [(r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.scan(odd, bench).collect()]
    assert [(n, hit, items) for i, t, n, hit, items in found if t == "null id"] == [(2, 2, ["1"])]
    assert all((n, hit, items) == (0, 0, []) for i, t, n, hit, items in found if not t)
    kept = decontamination.remove_contaminated(odd.withColumn("spans", F.lit(1)), bench)
    assert kept.columns == [*odd.columns, "spans"] and kept.count() == odd.count() - 1
    assert decontamination.remove_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.remove_contaminated(odd.limit(0), bench).count() == 0


def test_vocabulary_of_a_table(spark):
    terms = [("Casino", 1.5), ("casino", 0.5), ("bet", 0.75), (None, 9.0), ("", 9.0), ("bad", None), ("zero", 0.0), ("worst", 3.0), ("e-mail", 1.0)]
    table = spark.createDataFrame(terms, "term string, weight double")
    assert url_filter.vocabulary_of(table) == {"casino": 1.5, "bet": 0.75, "worst": 3.0, "e-mail": 1.0}
    cases = {"http://a.net/CASINO": ("allow", 0, 1, 1.5), "http://a.net/casino/bet": ("block", 0, 2, 2.25), "http://worst.net": ("block", 1, 0, 3.0), "http://a.net/worsted": ("allow", 0, 0, 0.0), "http://a.net/e-mail-bet/bet": ("allow", 0, 2, 1.75), None: ("allow", 0, 0, 0.0)}
    pages = spark.createDataFrame([(k, u, 5) for k, u in enumerate(cases)], "page_id long, url string, verdict int")
    rows = url_filter.judge(pages, vocabulary=table).orderBy("page_id").collect()
    assert [(r["verdict"], r["strict_hits"], r["soft_hits"], r["score"]) for r in rows] == list(cases.values())
    assert {r["verdict"] for r in url_filter.judge(pages, vocabulary={}).collect()} == {"allow"}


def test_keep_one_on_clashing_and_empty_tables(spark, odd):
    clashing = docs(spark, [(1, prose(40, 3), "en", "a"), (2, None, None, None), (3, "", None, None), (3, "", None, None)], ADDS)
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert near_dedup.keep_one(odd.limit(0)).count() == 0


def test_lines_of_odd_rows(spark, odd):
    long = "word " * 60_000
    d = odd.union(docs(spark, [(20, long), (21, long + "\n" + "tail that is long enough to count"), (None, "tail that is long enough to count!")]))
    rows = {(r["doc_id"], r["n_removed"]) for r in line_dedup.report(d).collect()}
    assert {(20, 0), (21, 2), (None, 0)} <= rows and all(n == 0 for i, n in rows if i in range(6))
    cut = line_dedup.deduplicate(d).where("doc_id = 21").first()
    assert cut["text"] == "" and cut["removed_chars"] == len(long) + 1 + 33


def test_url_rules_and_vocabulary(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "HTTP://Sub.Example.ORG/en/12?x": ("sub.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.net/porn/x": ("a.net", "/porn/x", None, "block"),
        "http://a.net/popcornporno": ("a.net", "/popcornporno", None, "allow"),
        "http://a.net/casino/Casino": ("a.net", "/casino/Casino", None, "allow"),
        "http://a.net/casino-poker": ("a.net", "/casino-poker", None, "block"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    found = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).orderBy("page_id").collect()]
    assert found == list(cases.values())


def test_quality_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, labels, trainable=~quality.held_out(F.col("doc_id")))
    rows = quality.score(d.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_levels_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    x, y, w = np.sort(r.uniform(0, 1, 40)), r.uniform(0, 1, 40), r.choice([1.0, 3.0, 1000.0], 40)
    centres, levels = quality.isotonic(x, y, w)
    assert (np.diff(centres) > 0).all() and (np.diff(levels) > 0).all() and len(levels) < 40
    # The level at k is the greatest over starts of the least over ends of the mean between them.
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    wanted = [max(min(mean(a, b) for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    assert sorted({round(v, 9) for v in wanted}) == pytest.approx(levels.tolist(), abs=1e-8)


def test_isotonic_small_end_pools_keep_their_order():
    _, levels = quality.isotonic(np.arange(4.0), np.array([0, 0.1, 0.9, 1]), np.array([1.0, 1000, 1000, 1]))
    assert levels.tolist() == [0, 0.1, 0.9, 1]


def test_quality_equals_a_fit_in_memory(spark):
    """Statistics by a plain loop, the normal equations and the calibration of all rows at once."""
    r = random.Random(8)
    texts = [prose(r.randint(5, 120), k) + (" #$% WOW!!! || <> $$$" * r.randint(1, 6) if k % 2 else "") for k in range(240)]
    y = np.array([1.0 - k % 2 if r.random() < 0.95 else k % 2 for k in range(240)])
    d = docs(spark, list(enumerate(texts)))
    model = quality.fit(d, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int"))
    stats = np.vstack([quality.statistics(pa.array([t])) for t in texts])
    assert model.mean == pytest.approx(stats.mean(0)) and model.scale == pytest.approx(np.maximum(stats.std(0), 1e-9))
    z = model.fourier(stats)
    ridge = quality.RIDGE * len(texts) ** 0.5 * np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    weights = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert z @ model.weights == pytest.approx(z @ weights, abs=1e-6)
    found = {x["doc_id"]: x["score"] for x in quality.score(d, model).collect()}
    order = np.argsort(z @ weights)
    assert (np.diff([found[k] for k in order]) >= 0).all()  # a better raw score never scores less
    assert np.mean([(found[k] >= 0.5) == y[k] for k in found]) > 0.9


def test_statistics_of_one_text_by_a_plain_loop():
    text = "Ab cd é! 12 ab\nThe the |x| $5 ab cd é!"
    found = quality.statistics(pa.array([text, None, ""]))
    words, letters = text.split(), [c for c in text if c.isalpha()]
    assert found[0][:3] == pytest.approx([np.log1p(len(text)), np.log1p(len(words)), sum(c.isupper() for c in text) / len(letters)])
    assert found[0][3] == pytest.approx(sum(c.isdigit() for c in text) / len(text))
    assert found[0][12] == pytest.approx(np.mean([len(w.encode()) for w in words]))
    assert (found[1] == found[2]).all()


def test_keep_good_keeps_rows_as_they_were(spark, odd):
    model = quality.fit(odd, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"))
    d = odd.withColumn("score", F.lit("own")).withColumn("predicted", F.lit(5))
    kept = quality.keep_good(d, model)
    assert kept.schema == d.schema and kept.exceptAll(d).count() == 0
    good = quality.score(odd, model).where("predicted = 1").count()
    assert kept.count() == good
    assert quality.keep_good(d.limit(0), model).count() == 0
