"""Near copies whose closest-looking links fail: no true link may be lost for them."""

import random

from inkveil.llm import near_dup


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def star(copies):
    """A base of 200 shingles and copies of it with three words changed: 0.86 like the base, mostly 0.74 like each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(204)]
    texts = [" ".join(base)]
    for c in range(copies):
        own = list(base)
        for k, place in enumerate(sorted(rng.sample(range(1, 33), 3))):
            own[place * 6] = f"x{c}x{k}"
        texts.append(" ".join(own))
    return texts


def test_star_of_near_copies(spark):
    texts = star(1500)
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    # by brute force every copy is linked to the base, so one component and one document is left
    assert all(alike(sets[0], s) for s in sets[1:])
    assert sum(alike(a, b) for a in sets[1:40] for b in sets[1:40] if a is not b) < 400
    lone = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([*enumerate(texts), (9000, lone), (9001, lone + " eleven twelve thirteen fourteen fifteen")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.keep_one(df).collect()) == [0, 9000, 9001]


def components(texts):
    """Components of the texts by exact similarity of all pairs: the smallest place of each."""
    sets = [shingles(t) or {tuple(t.split())} for t in texts]
    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    shared = {}
    for own in holders.values():
        for a in own:
            for b in own:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], pairs


def recall(spark, texts, **options):
    """The share of the exact pairs whose ends are in one component, and whether no component is too large."""
    exact, pairs = components(texts)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in near_dup.keep_one(df, **options).collect()}
    assert kept >= set(exact)  # the first of each component stays: nothing else than exact links joins
    lost = kept - set(exact)
    return 1 - sum(b in lost or a in lost for a, b in pairs) / max(len(pairs), 1), len(pairs)


def test_borderline_pairs(spark):
    """Sixty bases of 200 words with seven copies each, 2 to 9 words changed: many pairs are just above or below 0.8."""
    rng = random.Random(11)
    texts = []
    for b in range(60):
        base = [f"b{b}w{i}" for i in range(200)]
        texts.append(" ".join(base))
        for _ in range(7):
            own = list(base)
            for place in rng.sample(range(200), rng.randint(2, 9)):
                own[place] = f"z{rng.random()}"
            texts.append(" ".join(own))
    share, n = recall(spark, texts)
    assert n > 100 and share == 1


def test_large_blocks_are_tiled(spark, monkeypatch):
    """Blocks of many tiles give the same documents."""
    monkeypatch.setattr(near_dup.block_links, "__defaults__", (4,))
    share, n = recall(spark, star(40) + [f"{t} {' '.join(f'y{k}{i}' for i in range(60))}" for k, t in enumerate(star(10))])
    assert n > 30 and share == 1


def test_recall_on_documents(spark):
    """All exact pairs of the corpus at sf0.01 end in one component."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").collect()
    texts = [r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in rows]
    share, n = recall(spark, texts)
    assert n > 20 and share == 1
