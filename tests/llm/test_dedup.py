"""Line dedup, SimHash near-dedup and the links they share, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import components, lines, simhash
from pagemill.llm.queries import QUERIES


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    given = random.Random(seed)
    links = [(given.randrange(300), given.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    want = Union()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want.find(x) for x in linked}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spanning_links_are_few_and_complete():
    dense = components.spanning_links(lambda i, rest: np.ones(len(rest), bool), 500)
    assert len(dense) == 499
    chain = components.spanning_links(lambda i, rest: abs(rest - i) == 1, 50)
    assert len(chain) == 49


def groups(found):
    """The sets of ids under one component id."""
    out = defaultdict(set)
    for i, c in found:
        out[c].add(i)
    return sorted(map(sorted, out.values()))


def test_large_cells_lose_no_link(spark):
    given = random.Random(4)
    base = given.getrandbits(63)
    near = {base}
    while len(near) < 400:
        x = given.choice(sorted(near))
        for b in given.sample(range(63), 2):
            x ^= 1 << b
        near.add(x)
    fps = sorted(near | {given.getrandbits(63) for _ in range(400)})
    want = Union()
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                want.join(a, b)
    rows = simhash.cells(spark.createDataFrame([(x,) for x in fps], "fp long"))
    for largest in (16, 20_000):
        links = components.bucket_links(rows, components.linked_runs(*simhash._near(4)), largest)
        got = {r.node: r.root for r in components.components(links).collect()}
        assert {x: got.get(x, x) for x in fps} == {x: want.find(x) for x in fps}


def test_manhattan_is_a_lower_bound_and_exact():
    given = np.random.default_rng(1)
    a, b = given.integers(0, 1 << 63, (2, 500), np.uint64)
    b[:250] = a[:250] ^ (np.uint64(1) << given.integers(0, 63, 250).astype(np.uint64))
    counts = lambda x: [[(int(x) >> 2 * s & 3).bit_count() for s in range(32)] for x in x]
    want = [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(counts(a), counts(b))]
    assert simhash._manhattan(simhash._popcounts(a), simhash._popcounts(b)).tolist() == want
    assert (np.array(want) <= np.bitwise_count(a ^ b)).all()


def plain_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_against_brute_force(spark, sf, documents):
    texts = {r.doc_id: plain_fingerprint(r.text) for r in documents.collect()}
    want = Union()
    ids = sorted(texts)
    for i, a in enumerate(ids):
        want.find(a)
        for b in ids[i + 1 :]:
            if (texts[a] ^ texts[b]).bit_count() <= 4:
                want.join(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, sf).collect()}
    assert got == {i: (f"{texts[i]:016x}", want.find(i)) for i in ids}


def test_simhash_edges(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fp, r.component_id))
    assert {c for i in (3, 4, 5) for _, c in by[i]} == {3} and {f for i in (3, 4, 5) for f, _ in by[i]} == {0}
    assert len(by[2]) == 1 and (0, 3) in by[None]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.dedup(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) <= 1 and ids.count(3) == 1 and 4 not in ids and 5 not in ids
    assert simhash.dedup(empty).count() == 0


@pytest.mark.parametrize("largest", [7, simhash.LARGEST_BUCKET])
def test_stage_links_five_word_jaccard(spark, largest, monkeypatch):
    given = random.Random(12)
    word = lambda: "".join(given.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(60):
        own = [word() for _ in range(60 if k < 50 else 400)]
        rows.append(own)
        for _ in range(2):
            other = list(own)
            for at in given.sample(range(len(own)), (1 if k < 50 else given.choice((4, 7, 30)))):
                other[at] = word()
            rows.append(other)
    hub = [word() for _ in range(80)]
    rows += [[*hub[:40], word(), *hub[41:]] for _ in range(30)]
    sets = [{tuple(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    prints = [plain_fingerprint(" ".join(r)) for r in rows]
    want = Union()
    for i in range(len(rows)):
        want.find(i)
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4:
                want.join(i, j)
    monkeypatch.setattr(simhash.similar_texts, "__defaults__", (largest,))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == sorted({want.find(i) for i in range(len(rows))})


def test_rows_without_any_id_stay(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon"), (None, "one two three four five six")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.dedup(docs).collect()) == ["alpha beta gamma delta epsilon", "one two three four five six"]


def plain_line_dedup(rows):
    """{doc_id: set of removed positions} by comparing all lines."""
    places, sets = defaultdict(list), {5: {}, 3: {}}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = " ".join(line.lower().split())
            if line:
                places[line].append((i, pos))
                for size in sets:
                    sets[size][line] = {line[k : k + size] for k in range(max(1, len(line) - size + 1))}
    want, given = Union(), list(places)
    owners = defaultdict(list)
    for line in given:
        want.find(line)
        for size, own in sets.items():
            both = defaultdict(int)
            for s in own[line]:
                for other in owners[size, s]:
                    both[other] += 1
                owners[size, s].append(line)
            for other, n in both.items():
                asked = 3 if min(len(line), len(other)) < 50 else 5
                if size == asked and n >= 0.8 * (len(own[line]) + len(own[other]) - n) - 1e-9:
                    want.join(line, other)
    members = defaultdict(list)
    for line in given:
        members[want.find(line)] += places[line]
    gone = defaultdict(set)
    for group in members.values():
        for i, pos in set(group) - {min(group)}:
            gone[i].add(pos)
    return gone


def test_op1_against_brute_force(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = plain_line_dedup(rows)
    got = {r.doc_id: r for r in QUERIES["op1_lines"](spark, sf).collect()}
    assert {i: set(r.removed or ()) for i, r in got.items()} == {i: want.get(i, set()) for i, _ in rows}
    for i, text in rows:
        assert got[i].text == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in want.get(i, ()))
        assert got[i].n_removed == len(want.get(i, ()))


def test_lines_of_few_shingles(spark):
    """A short line and a long one with the same shingles are copies; so are long ones."""
    rows = [(1, "-" * 40), (2, "-" * 80), (3, "ab" * 20), (4, "ab" * 300), (5, "=" * 70), (6, "x" + "-" * 30 + "y")]
    got = {r.doc_id: r.removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="removed").collect()}
    want = plain_line_dedup(rows)
    assert {i: set(r or ()) for i, r in got.items()} == {i: want.get(i, set()) for i, _ in rows}
    assert got[2] == [0] and got[4] == [0] and not got[5]


def test_any_column_names(spark):
    names = "__id __hash __id0 __hash0 __removed".split()
    rows = [(1, "one line of some words\nand another one", *names), (2, "one line of some words", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    cleaned = lines.dedup_lines(docs)
    assert cleaned.columns == docs.columns and {tuple(r) for r in cleaned.collect()} == {rows[0], (2, "", *names)}
    kept = simhash.dedup(docs.unionAll(docs))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == set(rows)


def test_near_lines_in_hot_buckets(spark):
    given = random.Random(7)
    words = [f"w{given.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(300):
        own = list(words)
        own[given.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own) + "\nonly here " + str(given.random()) * 3))
    want = plain_line_dedup(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for largest in (20, 2_000):
        got = {r.doc_id: set(r.removed) for r in lines.duplicate_lines(docs, largest).collect()}
        assert got == {i: s for i, s in want.items() if s}


def line_similarity(a, b):
    """Five-character Jaccard; three-character if the shorter line is below 50 characters."""
    k = 3 if min(len(a), len(b)) < 50 else 5
    x, y = ({line[i : i + k] for i in range(max(1, len(line) - k + 1))} for line in (a, b))
    return len(x & y) / len(x | y) if k == 5 or max(len(a), len(b)) < 65 else 0


@pytest.mark.parametrize("largest", [8, 2_000])
def test_edited_lines_of_any_length_are_copies(spark, largest):
    given = random.Random(21)
    letter = lambda: given.choice("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(letter() for _ in range(given.randrange(2, 9)))
    pairs = []
    for n in range(30, 151):
        for kind in ("character", "word"):
            line = ""
            while len(line) < n:
                line += " " * bool(line) + word()
            line = line[: n - 1] + "x"
            if kind == "character":
                at = given.choice([i for i in range(3, n - 3) if line[i] != " "])
                other = line[:at] + ("q" if line[at] != "q" else "z") + line[at + 1 :]
            else:
                words = line.split(" ")
                words[len(words) // 2] = "".join(letter() for _ in range(6))
                other = " ".join(words)
            pairs.append((kind, line, other))
    hot = [("hot", a, b) for base in (word() + " " + word() + " " + "of the seven hills and rivers here",) for a, b in [(base, base[:20] + str(k) + base[21:]) for k in range(10)]]
    rows = [(2 * k, a) for k, (_, a, _) in enumerate(pairs + hot)] + [(2 * k + 1, b) for k, (_, _, b) in enumerate(pairs + hot)]
    rows += [(10**6 + k, f"nothing {word()} {word()} {word()} {word()} alike") for k in range(200)]
    given_lines = sorted({t for _, t in rows})
    want = Union()
    for i, a in enumerate(given_lines):
        want.find(a)
        for b in given_lines[:i]:
            if line_similarity(a, b) >= 0.8 - 1e-9:
                want.join(a, b)
    members = defaultdict(list)
    for i, t in rows:
        members[want.find(t)].append(i)
    gone = {i for group in members.values() for i in group if i != min(group)}
    got = {r.doc_id for r in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), largest).collect()}
    assert got == gone  # nothing is lost, and nothing merged that isn't alike
    found = lambda kind, least: np.mean([2 * k + 1 in got for k, (x, a, _) in enumerate(pairs) if x == kind and len(a) >= least])
    assert found("character", 30) == 1 and found("word", 100) == 1
    assert not any(i >= 10**6 for i in got)


def test_line_edges(edges, empty):
    out = lines.dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    rows = defaultdict(set)
    for r in out.collect():
        rows[r.doc_id].add(r.text)
    assert rows[3] == {None} and rows[4] == {""} and rows[5] == {" \n\t\n"}
    assert rows[2] == {""} and len(rows[1]) == 1 and "" not in rows[1]
    assert lines.dedup_lines(empty).count() == 0


def test_signatures_do_not_depend_on_the_lines_around():
    given = random.Random(3)
    some = ["".join(given.choice("abcdé𝒳 ") for _ in range(n)) for n in (1, 5, 8, 9, 10, 300, 70_000)]
    whole = lines.signatures(some)
    assert all((lines.signatures([x]) == whole[i]).all() for i, x in enumerate(some))
    short = lines.signatures(["abc"] * 2)
    assert (short[0] == short[1]).all()


def test_dedup_is_stable_over_partitionings(documents):
    count = lambda n: lines.duplicate_lines(documents.repartition(n)).agg(F.sum(F.size("removed"))).first()[0]
    assert count(1) == count(7)


def test_runs_across_batches():
    prepare, pair = simhash._near(4)
    run = components.linked_runs(prepare, pair)
    table = pa.table({"bucket": [1, 1, 1, 1, 2, 3, 3], "id": [0, 1, 3, 1 << 40, 9, 5, 4]})
    for size in (1, 2, 3, 7):
        found = {(u, v) for b in run(iter(table.to_batches(max_chunksize=size))) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())}
        want = Union()
        for u, v in found:
            want.join(u, v)
        assert want.find(0) == want.find(1) == want.find(3) == want.find(1 << 40) and want.find(4) == want.find(5)


def test_shared_rows_over_batches():
    given = random.Random(9)
    for _ in range(200):
        rows = sorted((given.randrange(8), given.randrange(4)) for _ in range(given.randrange(1, 25)))
        table = pa.table({"bucket": [b for b, _ in rows], "id": [i for _, i in rows]})
        size = given.choice([1, 2, 3, 50])
        found = [r for x in lines._shared(iter(table.to_batches(max_chunksize=size))) for r in zip(x.column("bucket").to_pylist(), x.column("id").to_pylist())]
        of = defaultdict(set)
        for b, i in rows:
            of[b].add(i)
        assert found == sorted((b, i) for b, ids in of.items() if len(ids) > 1 for i in ids)


def test_shingles_as_numbers_are_those_of_the_line():
    """The same counts and overlaps for any characters, and the same sizes for lines taken together."""
    given = random.Random(3)
    letters = ["a", "b", " ", "é", "ж", "\u0fff", "\u1000", "北", "𝒳", "\U0010fffe", "\0", "\ud800"]
    made = ["".join(given.choice(letters[: given.choice((1, 4, 12))]) for _ in range(given.randrange(1, 30))) for _ in range(4000)]
    for size in (lines.SHINGLE, lines.SHORT_SHINGLE):
        for a, b in zip(made, made[1:]):
            plain, own = [set(lines.shingles(x, size)) for x in (a, b)], [lines.shingle_set(x, size) for x in (a, b)]
            assert (*map(len, plain), len(plain[0] & plain[1])) == (*map(len, own), len(own[0] & own[1]))
            assert lines.as_numbers(a, size) == all(isinstance(x, int) for x in own[0])
    long = [x * given.randrange(1, 40) for x in made[:1000]] + ["".join(map(chr, range(97, 97 + n))) * 3 for n in range(1, 70)]
    assert lines.sizes_of(long) == [lines.shingle_sizes(x) for x in long]
    assert lines.sizes_of([]) == []


def test_lines_are_compared_as_sorted_numbers(monkeypatch):
    """The same links as by sets of strings, and no Python set where every shingle has a number."""
    given = random.Random(31)
    alphabets = ["ab ", "abcdefghij ", "éßж ", "北京市ab ", "a\U0001f600b"]
    for _ in range(60):
        alphabet = given.choice(alphabets)
        base = "".join(given.choices(alphabet, k=given.choice([1, 4, 30, 48, 52, 200])))
        made = [base]
        for _ in range(given.choice([1, 5, 30])):
            x = list(given.choice(made))
            for _ in range(given.randrange(4)):
                x[given.randrange(len(x))] = given.choice(alphabet)
            made.append("".join(x) + given.choice(["", "", "-", alphabet]))
        plain_sets = {(x, size): set(lines.shingles(x, size)) for x in made for size in (3, 5)}

        def plain(a, b, sets=plain_sets):
            size = 3 if min(len(a), len(b)) < 50 else 5
            a, b = sets[a, size], sets[b, size]
            return len(a & b) >= 0.8 * len(a | b) - 1e-9

        near, every = lines.similar(pa.table({"text": made})), np.arange(len(made))
        for i, x in enumerate(made):
            assert near(i, every).tolist() == [plain(x, y) for y in made] == [lines.alike_lines(x, y) for y in made]
    monkeypatch.setattr(lines, "shingle_set", None)
    few = ["the same words in a line of more than fifty characters, " + x for x in ("here", "there")]
    few.append("quite another line, of more than fifty characters as well, été")
    assert lines.similar_pairs(pa.table({"text": few}), np.array([0, 1])).tolist() == [True, False]
    assert lines.similar(pa.table({"text": few}))(0, np.arange(3)).tolist() == [True, True, False]
    assert lines.similar(pa.table({"text": few * 9}))(0, np.arange(3)).tolist() == [True, True, False]


def test_buckets_of_lines_are_compared_together(monkeypatch):
    """The links of the comparison one by one, which is not called; shingles that no number holds are left to it."""
    given = random.Random(41)
    alphabets = ["ab ", "abcdefghij ", "éßж ", "北京市ab ", "a\U0001f600b", "".join(map(chr, range(0x4E00, 0x6E00)))]
    rows = []
    for bucket in range(60):
        alphabet = given.choice(alphabets[:5] if bucket % 20 else alphabets[5:])
        base = "".join(given.choices(alphabet, k=given.choice([1, 2, 4, 30, 48, 52, 200, 9000 if alphabet == alphabets[5] else 400])))
        made = {base}
        for _ in range(given.choice([1, 2, 5, 30])):
            x = list(given.choice(sorted(made)))
            for _ in range(given.randrange(4)):
                x[given.randrange(len(x))] = given.choice(alphabet)
            made.add("".join(x) + given.choice(["", "-", alphabet[:9]]))
        rows += [(bucket, len(rows) + k, x) for k, x in enumerate(sorted(made))]
    table = pa.table({"bucket": [r[0] for r in rows], "id": [r[1] for r in rows], "text": [r[2] for r in rows]})
    links = lambda *a: {(u, v) for b in components.linked_runs(*a)(iter(table.to_batches(max_chunksize=100))) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())}
    assert links(lines.similar, lines.similar_pairs, lines.similar_rows, lines.TOGETHER) == links(lines.similar)
    monkeypatch.setattr(lines, "alike_codes", None)
    few = ["the same words in a line of more than fifty characters, " + x for x in ("here", "there")]
    few.append("quite another line, of more than fifty characters as well, été")
    assert lines.similar_pairs(pa.table({"text": few}), np.array([0, 1])).tolist() == [True, False]
    assert lines.similar_rows(pa.table({"text": few}))(np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [True, False, False]


def test_bucket_rows_travel_packed():
    """Parts of any size, and parts that a task can't hold, give the distinct rows of shared buckets."""
    given = random.Random(43)
    for most in (1, 2, 7, 10**6):
        for _ in range(40):
            rows = [(given.choice([-(1 << 63), -5, 0, 7, 1 << 62, (1 << 63) - 1]) + given.randrange(3) * given.choice([0, 1 << 20]) % 2, given.randrange(-4, 4)) for _ in range(given.randrange(1, 40))]
            table = pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "id": pa.array([i for _, i in rows], pa.int64())})
            packs = [x for b in lines.packed(iter(table.to_batches(max_chunksize=9)), 5) for x in b.to_pylist()]
            packs += [x for b in lines.packed(iter(table.to_batches(max_chunksize=4)), 5) for x in b.to_pylist()]
            assert all(0 <= x["part"] < 5 for x in packs)
            packs = pa.Table.from_pylist(sorted(packs, key=lambda x: x["part"]), pa.schema([("part", pa.int32()), ("rows", pa.binary())]))
            found = [x for b in lines.unpacked(iter(packs.to_batches(max_chunksize=3)), most) for x in b.to_pylist()]
            of = defaultdict(set)
            for b, i in rows:
                of[b].add(i)
            want = sorted((b, i) for b, ids in of.items() if len(ids) > 1 for i in ids)
            assert sorted({(x["bucket"], x["id"]) for x in found}) == want
            assert len(found) == len(want) or any(x["again"] for x in found)


def test_normal_lines_are_those_taken_one_by_one():
    given = random.Random(44)
    for _ in range(5000):
        text = "".join(given.choices(["a", "B", " ", "\n", "\t", "\x85", "　", "Σ", "İ", " ", "\x1c", "."], [5, 3, 2, 1, 0.1, 0.1, 0.1, 1, 0.3, 0.1, 0.1, 0.3], k=given.randrange(1, 14)))
        assert lines.normal_lines(text) == [lines.normal(x) for x in text.split("\n")]


def test_large_buckets_compare_only_what_is_left(monkeypatch):
    """A line that is like no other does not have all of the bucket counted against each of them."""
    words = [f"word{k}" for k in range(60)]
    made = [" ".join([*words[:k], "edited", *words[k + 1 :]]) for k in range(60)] * 2 + ["the one that is quite unlike " * 9]
    counts, plain = [], lines._counted

    def counting(*given):
        near = plain(*given)
        return lambda i, rest: counts.append(len(rest)) or near(i, rest)

    monkeypatch.setattr(lines, "_counted", counting)
    links = components.spanning_links(lines.similar(pa.table({"text": made})), len(made))
    assert len(links) == 119 and sum(counts) < 2 * len(made)
