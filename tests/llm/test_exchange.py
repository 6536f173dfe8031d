import numpy as np
import pandas as pd

from sedimenta.llm import exchange


def test_totals_of_any_size(spark):
    keys, counts = np.array([5, 6, 700], np.uint64), np.array([3_000_000_000, 1, 200])
    sent = pd.concat([exchange.send(b, keys, counts, 16, 8) for b in range(3)])
    got = exchange.totals(spark.createDataFrame(sent, exchange.SENT), 16, 8).toPandas()
    assert {b: exchange.received(g).tolist() for b, g in got.groupby("block")} == {b: [9_000_000_000, 3, 600] for b in range(3)}
