"""Words of a bucket are numbered without a step of Python for each of them."""

import cProfile
import pstats

import numpy as np

from cardwarden.llm import substring_dedup as s


def test_no_call_for_each_distinct_word():
    n = 3_000
    shared = [b"s%d" % i for i in range(60)]
    texts = [b" ".join([b"a%d" % i for i in range(n)] + shared), b" ".join(shared + [b"b%d" % i for i in range(n)])]
    chunk = s.Chunk(texts, s.WINDOW, s.Hasher())
    sent = s.parcels(chunk, np.array([1, 2]), np.zeros(2, np.int32), s.WINDOW, np.zeros(0, np.uint64), 1)
    bucket = s.Bucket(s.WINDOW)
    for _, *row in sent:
        bucket.add(*row)
    profile = cProfile.Profile()
    found = profile.runcall(lambda: list(bucket.covered()))
    (ids, _, starts, lengths), = found
    covered = sorted(x for a, k in zip(starts.tolist(), lengths.tolist()) for x in range(a, a + k))
    assert set(ids.tolist()) == {2} and covered == list(range(11))  # the windows of the 60 shared words
    assert pstats.Stats(profile).total_calls < n
