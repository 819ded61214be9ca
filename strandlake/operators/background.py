"""Random sequences like given ones."""

import numpy as np
import pyarrow as pa


def markov(seqs, transitions, seed=1):
    """seq_id, u: for each sequence one of equal length by a third-order Markov chain.

    transitions: [(context, next, n)] of bases, at most 256 rows, which are broadcast; contexts without any are uniform,
    as are the first three bases. A sequence's draws hang on its id and the seed alone, so a repeated task repeats them.
    """
    counts = np.ones((64, 4)) * 1e-12
    for context, base, n in transitions:
        counts[sum("ACGT".index(c) * 4 ** (2 - j) for j, c in enumerate(context)), "ACGT".index(base)] += n
    shared = seqs.sparkSession.sparkContext.broadcast((counts / counts.sum(axis=1, keepdims=True)).cumsum(axis=1))

    def run(batches):
        upto = [row.tolist() for row in shared.value]
        for b in batches:
            out = []
            for seq_id, u in zip(b.column("seq_id").to_pylist(), b.column("u").to_pylist(), strict=True):
                draws = np.random.default_rng([seed, seq_id & 0xFFFFFFFF]).random(len(u or "")).tolist()
                bases = []
                for i, x in enumerate(draws):
                    row = (0.25, 0.5, 0.75, 1.0) if i < 3 else upto[16 * bases[-3] + 4 * bases[-2] + bases[-1]]
                    bases.append(0 if x < row[0] else 1 if x < row[1] else 2 if x < row[2] else 3)
                out.append("".join("ACGT"[k] for k in bases))
            yield pa.record_batch([b.column("seq_id"), pa.array(out, pa.string())], names=["seq_id", "u"])

    return seqs.select("seq_id", "u").mapInArrow(run, "seq_id long, u string")
