from pathlib import Path

import pyarrow.parquet as pq
import pytest

#: Texts that hurt: none, blank, tiny, repeated, long, other alphabets, special strings, control characters.
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. "
TEXTS = [None, "", " ", "\n\n", "one", "One two", "one two", BASE * 3, BASE * 3, (BASE * 3).upper(), BASE * 3 + "phi",
         "".join(f"w{i} x{i * 7 % 1001} " for i in range(3000)), "中文 текст ελληνικά ²½ á", "<|endoftext|> a <|endoftext|>",
         "a\x1c\x1fb\x00c  d \t e", "it's   we'll\r\n", "x" * 20_000, "É" * 300]


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[7], rows[0], (None, BASE * 3, None, None, 5), (None, None, "en", "s1", 0), (rows[9][0], "other", "en", "é", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd texts with null and repeated ids and rows, and more columns, named as operators name theirs."""
    more = ("file long, row long, key string, size string, copies int, shard int, tokens string, doc string, finger int, "
            "source_size int, target int, kept boolean, task int, uid long, score int")
    width = len(more.split(", "))
    return spark.createDataFrame([r + (None,) * width for r in odd_rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + more)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def real(sf_dir):
    """(doc_id, text) of the test documents."""
    table = pq.read_table(Path(sf_dir, "documents.parquet"))
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def rows_of(df):
    return [r.asDict() for r in df.collect()]
