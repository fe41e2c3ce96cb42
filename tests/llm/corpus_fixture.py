"""A small corpus with every awkward case, and plain versions of the operators to hold results against."""

import re
from itertools import combinations

SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = ("the river ran past old mills where grain was ground and boats lay tied in rows while children threw stones at tin cans under a grey sky and nobody came to call "
         "them home until lamps were lit along both banks and dogs began to bark at carts that rolled over wet planks towards market squares full of noise").split()


def passage(start, n, step=7):
    return " ".join(PROSE[(start + k * step) % len(PROSE)] + str((start * 31 + k) % 97) for k in range(n))


ITEMS = [(1, passage(3, 24)), (2, passage(11, 12) + " Ünïcode wörds"), (3, "tiny test item"), (4, ""), (5, None), (6, passage(3, 24)), (None, passage(50, 11))]


def documents():
    base = passage(5, 60)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (0, 30, 59)]
    rows = [
        (1, base), (2, base.upper()), (3, base), (4, near[0]), (5, near[1]), (6, near[2]), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "One"), (12, "one two three"),
        (13, passage(20, 30) + " " + passage(3, 24) + " " + passage(21, 30)), (14, "x " * 3 + passage(3, 9)), (15, "a tiny TEST item here"), (16, passage(40, 200)),
        (17, passage(40, 190) + " tail"), (18, passage(60, 15) + " " + passage(70, 20)), (19, passage(80, 5) + " " + passage(70, 20)), (20, passage(70, 20)),
        (21, "same same same same " * 12), (22, "É é Ünï " + passage(2, 14)), (23, "!!! ... ???"), (24, passage(90, 12_000)), (25, passage(11, 12) + " ünïcode Wörds")]
    rows += [(3, base), (10, "one"), (10, "different text under a known id"), (None, base), (None, None)]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                     *(F.lit(1).alias(c) for c in ("row", "block", "n", "shard", "score", "spans", "given", "fp", "rank", "chunk", "lang_pred", "key", "size",
                                              "_id", "_fp", "_fp0", "_sha", "_one", "_conv", "id", "sha", "one", "told", "kept", "cls", "comp", "class_id")))


def split(text):
    return [w for w in SPACES.split(text or "") if w]


def least_first(i):
    return (i is None, i or 0)


def substring(rows, window=13):
    """(doc_id, n_words, n_removed, kept) of each row."""
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, (True, 0)), least_first(i))
    out = []
    for i, t in rows:
        w = split(t)
        cut = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < least_first(i):
                cut[k:k + window] = [True] * window
        out.append((i, len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c)))
    return out


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    return [(i, max((x for x in g if x is not None), default=None), len(g)) for i, t in rows for g in [groups[(t or "").translate(LOW)]]]


def shingles(text, n):
    w = split((text or "").translate(LOW))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 0)), least_first(i))
    return [(i, len(sets[k]), i if not sets[k] else None if best[find(k)][0] else best[find(k)][1]) for k, (i, _) in enumerate(rows)]


def hits(rows, items, window=10):
    """(doc_id, n_words, n_hit, items) of each row."""
    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOW))

    wanted = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    lengths = {len(k) for k in wanted}
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (names := wanted.get(tuple(w[k:k + n]))):
                    found |= names
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
