import hashlib
import random
import re

import xxhash

from chainloom.llm import fingerprints as fp

MASK = (1 << 64) - 1
UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-ㄯㆠ-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")


def tokens_by_hand(text):
    out = []
    for run in re.split(r"[\x20\x09-\x0D]+", UNSPACED.sub(r" \g<0> ", text or "")):
        out += list(run) if len(run) > fp.TOKEN_CHARS else [run] if run else []
    return out


def rotated(x, by):
    return ((x << by) | (x >> (64 - by))) & MASK if by else x


def winnow_by_hand(text, k=fp.GRAM, w=fp.WINDOW):
    """Selected (hash, position), with the hash rolled from one gram to the next."""
    h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens_by_hand(text)]
    if not h:
        return []
    h += [0] * max(0, k - len(h))
    rolled = 0
    for x in h[:k]:
        rolled = rotated(rolled, 1) ^ x
    grams = [rolled]
    for i in range(k, len(h)):
        rolled = rotated(rolled, 1) ^ rotated(h[i - k], k % 64) ^ h[i]
        grams.append(rolled)
    order = [g >> (fp.PLACE_BITS + 1) for g in grams]
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        part = order[i : i + w]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if (grams[at], at) not in chosen:
            chosen.append((grams[at], at))
    return chosen


TEXTS = ["", None, "a", "a b c", "one two three four five six seven", "a b " * 40, "x" * 500, "xy" * 100 + " tail", "Ünï çödé " * 9, " lead  and\ttrail \n", "漢字かなと text mixed ไทย", "😀" * 70, "𠀋𠀋 x"]


def selected_of(row):
    return [(x.hash & MASK, x.position) for x in row.selected]


def test_winnowing_against_python(spark):
    rng = random.Random(1)
    rows = list(enumerate(TEXTS + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(80))) for _ in range(30)]))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, selected int, hash string")
    for r in fp.fingerprint(df).collect():
        assert selected_of(r) == winnow_by_hand(rows[r.doc_id][1]), rows[r.doc_id]


def shared(spark, make, glue):
    """Texts with one passage of w + k - 1 tokens each: all pairs share a hash, at places the same distance apart as the passages."""
    rng = random.Random(3)
    passage = [make(rng) for _ in range(fp.GRAM + fp.WINDOW - 1)]
    rows, starts = [], []
    for i in range(12):
        before, after = ([make(rng) for _ in range(rng.randrange(70, 110))] for _ in range(2))
        rows.append((i, glue.join([*before, *passage, *after])))
        starts.append(len(before))
    got = {r.doc_id: dict(selected_of(r)) for r in fp.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for a in got:
        for b in got:
            assert any(got[a][h] - starts[a] == got[b][h] - starts[b] for h in got[a].keys() & got[b].keys())


def test_shared_passage_is_found_with_its_positions(spark):
    shared(spark, lambda rng: "".join(rng.choice("abcdefghij") for _ in range(5)), " ")


def test_shared_passage_without_spaces_is_found(spark):
    shared(spark, lambda rng: chr(rng.randrange(0x4E00, 0x4F00)), "")
    shared(spark, lambda rng: rng.choice("abcdefghijklmnopqrstuvwxyz0123456789{}();="), "")


def check_edited(spark, rows, **options):
    key = lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))
    order = sorted(rows, key=key)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text = lambda f: ",".join(f"{p}:{h:x}" for h, p in f)
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        f = [winnow_by_hand(x) for x in (t, edited, after)]
        a, b, c = ({h for h, _ in x} for x in f)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f[0]), text(f[1]), round(like(a, b), 9), round(like(a, c), 9), len(a)))
    got = fp.compare_edited(spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], "doc_id bigint, text string, bucket int, row string, next string"), **options).collect()
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.n_hashes) for r in got]
    assert sorted(got) == sorted(want)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_edited_texts_against_python(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-500, 4000), 90)
    check_edited(spark, [(i, rng.choice([None, "", "ab", "é" * 7, "漢字" * 50, " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(rng.randrange(70)))])) for i in ids])


def test_crowded_ids_against_python(spark, monkeypatch):
    """Ids and whole rows that repeat, in buckets that are cut on."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    rows = [(rng.choice([None, 7, 7, 7, 8, 300, 301, 5000]), " ".join(word() for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [(7, "same text again and again"), (None, "same text again and again")] * 20
    plain = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda *a: plain(*a, crowded=10))
    check_edited(spark, rows)


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, bucket int, row string"
    assert fp.compare_edited(spark.createDataFrame([], kind)).count() == 0
    one = fp.compare_edited(spark.createDataFrame([(1, "abc def", 0, "")], kind)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200_000)), 0, "")], kind)
    assert 40_000 < fp.compare_edited(long).collect()[0].n_hashes < 60_000
    check_edited(spark, [(None, "x y"), (7, "p"), (7, "q"), (7, "q"), (9, "word " * 1_500)])


def test_next_buckets_in_levels(spark):
    ids = sorted(random.Random(2).sample(range(-(10**9), 10**9), 6000))
    links = {r.bucket: r.next_bucket for r in fp._next_buckets(spark.createDataFrame([(i,) for i in ids], "bucket bigint")).collect()}
    assert links == {b: a for a, b in zip([None, *ids], ids, strict=False)}
