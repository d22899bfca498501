"""Change packages and version-gated results."""

import shutil
import uuid

from loomspark.session import shared_dir
from loomspark.streaming import packages as P


def log(spark, *rows):
    return spark.createDataFrame(list(rows), P.CHANGES)


def put(seq, key, value, op="update", old=None, epoch=1, table="t"):
    return (seq, epoch, table, op, key, old, None if op == "delete" else f'{{"v": {value}}}', "nb", None)


def state(spark, root, table="t"):
    return {r.key: (r.seq, r.v) for r in P.applied(spark, root, table, "v int").collect()}


def test_packages(spark):
    root = f"{shared_dir(spark)}/packages/{uuid.uuid4().hex}"
    first = log(spark, put(1, '{"a": 1, "b": 2}', 1, "insert"), put(2, '{"b": 2, "a": 1}', 2), put(3, '{"a": 9}', 3, "insert"), put(4, '{"a": 9}', 0, "delete"), put(5, '{"a": 7}', 5, "insert", table="u"))
    one = P.write_package(first, root, "home", 0)
    assert one.startswith("home-1-1-5-") and P.write_package(first, root, "home", 0) == one
    assert [(r.puts, r.deletes, r.from_seq, r.to_seq) for r in P.manifests(spark, root).collect()] == [(2, 1, 1, 5)]
    assert state(spark, root) == {'{"a":"1","b":"2"}': (2, 2)} and state(spark, root, "u") == {'{"a":"7"}': (5, 5)}
    # A changed key is a delete and a put; a later change of the new key in the same batch has the last word.
    P.write_package(log(spark, put(6, '{"a": 5}', 6, old='{"a": 1, "b": 2}'), put(7, '{"a": 5}', 7)), root, "home", 1)
    assert state(spark, root) == {'{"a":"5"}': (7, 7)}
    # What arrives late does no harm, what has no manifest is not there, an empty batch is no package.
    P.write_package(log(spark, put(0, '{"a": 5}', 100)), root, "home", 2)
    half = P.write_package(log(spark, put(50, '{"a": 5}', 50)), root, "home", 3)
    shutil.rmtree(f"{root}/manifests/of={half}")
    assert state(spark, root) == {'{"a":"5"}': (7, 7)}
    assert P.write_package(log(spark).limit(0), root, "home", 4) is None
    # A new epoch voids what was before, within a batch too.
    P.write_package(log(spark, put(8, '{"a": 3}', 8), put(1, '{"a": 4}', 9, "insert", epoch=2)), root, "home", 5)
    assert state(spark, root) == {'{"a":"4"}': (1, 9)}


def test_versions(spark):
    store, made = f"{shared_dir(spark)}/versions/{uuid.uuid4().hex}", []

    def result(n):
        return lambda: made.append(n) or spark.range(n)

    ask = lambda name, epoch, seq, n: (lambda df, fresh: (df.count(), fresh))(*P.versioned(spark, store, name, epoch, seq, result(n)))
    assert ask("x", 1, 5, 3) == (3, True) and ask("x", 1, 5, 4) == (3, False)
    assert ask("x", 1, 6, 4) == (4, True) and ask("y", 1, 6, 2) == (2, True)
    assert ask("x", 2, 5, 9) == (9, True) and ask("x", 2, 5, 1) == (9, False)
    assert made == [3, 4, 2, 9]
