"""Documents for tests."""

#: Extra columns whose names operators use inside, or that need quoting.
EXTRA = {"tie": 1, "fp": 2, "key": "k", "start": 3, "block": 4, "n": 5, "id": 6, "held_out": True, "pii_spans": "x", "first": 7, "label": 8, "component_id": 9, "ids": "y", "score": 0.5, "_ends": 1, "_steps": 2, "_before": 3, "_pii_text": "q", "_pii": 4, "_m_email": 5, "_s_email": 6, "_nr": 8, "_keep_t": 9, "hash": 10, "a.b": 11, "c`d": 12}


def docs_frame(spark, rows, extra=False):
    """Documents of (doc_id, text); with `extra` also columns with clashing names."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def prose(rnd, n, words=None):
    words = words or [a + b for a in "ba de ki lo mu na".split() for b in "r st nt ly sh".split()]
    return " ".join(rnd.choice(words) for _ in range(n))
