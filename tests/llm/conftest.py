import random

import pytest
from samples import prose


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, very long texts, copies, near copies, repeated rows, odd characters."""
    rnd = random.Random(4)
    base = [prose(rnd, 120) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0]), (11, base[0]), (12, base[1].replace(" ", "  ")), (13, base[2] + " extra"), (20, None), (21, ""), (22, " \n\t "), (None, base[3]), (None, None)]
    rows += [(30, prose(rnd, 30_000)), (31, "É" * 70 + "😀" * 30), (32, "İΣ x<|endoftext|>y can't"), (33, "a"), (34, "word " * 3000)]
    return rows
