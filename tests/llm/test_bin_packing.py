import random

import numpy as np
import sentencepiece
from lodestone.llm import bin_packing as bp
from lodestone.llm import sentencepiece_codec as sc


def slow(lengths, sizes):
    """The same rule, looking at every open bin and every later piece."""
    bins, out = [], []
    for k, length in enumerate(lengths):
        fit = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= length]
        if fit:
            b = min(fit)[1]
        else:
            best = []
            for s in sizes:
                if s >= length:
                    later = sum(x for x in lengths[k + 1 :] if x <= s - length)
                    best.append((bp.cost(s) / (length + min(s - length, later)), s))
            bins.append([min(best)[1], 0])
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1] += length
    return out, [min(s for s in sizes if s >= used) for _, used in bins]


def test_against_slow_packing():
    rng = random.Random(3)
    for _ in range(60):
        sizes = tuple(sorted(rng.sample(range(5, 80), rng.randrange(1, 5))))
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(1, 80))), reverse=True)
        b, o, final = bp.pack(np.array(lengths), sizes)
        assert (list(zip(b.tolist(), o.tolist(), strict=True)), final.tolist()) == slow(lengths, sizes)


def test_table(spark):
    rng = random.Random(1)
    rows = [(i, "\n" * rng.choice([0, 10, 500, 1022, 8190, 8191, 20000])) for i in range(300)] + [(300, None), (None, "é x" * 700), (5, "again"), (5, "again"), ((1 << 60) + 1, "a b c")]
    lib = sentencepiece.SentencePieceProcessor(model_proto=sc.default_model())
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, bin_id int").repartition(3)
    got = bp.best_fit(spark, bp.token_lengths(docs)).collect()
    bins = {}
    for r in got:
        bins.setdefault((r["bin_id"], r["bin_size"], r["bin_used"]), []).append((r["bin_offset"], r["length"]))
    for (_, size, used), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == used <= size and not any(used <= s < size for s in bp.SIZES)
    assert len({b for b, _, _ in bins}) == len(bins)
    want = sorted((i if i is not None else -1, len(lib.encode(t or "")) + 1) for i, t in rows)
    total = {}
    for r in got:
        total[r["doc_id"] if r["doc_id"] is not None else -1] = total.get(r["doc_id"] if r["doc_id"] is not None else -1, 0) + r["length"]
    sums = {}
    for i, n in want:
        sums[i] = sums.get(i, 0) + n
    assert total == sums
    assert bp.best_fit(spark, bp.token_lengths(docs.limit(0))).count() == 0
