"""Secrets are replaced whole, however long, and numbers after a key word are secrets."""

import random

from inkveil.llm import pii


def test_secrets_are_replaced_whole(spark):
    rng = random.Random(3)
    long = ["".join(rng.choices("ABCDEFghijkl0123456789_/+", k=n)) for n in (256, 257, 604, 1000, 20000)]
    number = "1234567890123"
    texts = [f"see token={v}, then" for v in long] + [f"password={number}", f"order {number} of", f'{number} and "key: {number}" here', "no secret", None]
    out = [r.text for r in sorted(pii.replace(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "k").collect())]
    for v, t in zip(long, out):
        head, tail = t.removeprefix("see token=").removesuffix(", then"), t[-6:]
        assert tail == ", then" and len(head) == len(v) and not any(v[i : i + 24] in t for i in range(0, len(v) - 24))
    password, order, both = out[5:8]
    secret = password.removeprefix("password=")
    assert len(secret) == 13 and secret != number
    assert order == f"order {number} of" and both == f'{number} and "key: {secret}" here'
    assert out[8:] == ["no secret", None]
