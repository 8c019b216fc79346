import gzip
import re
from collections import Counter

from keyloom.llm import warc


def test_repeated_and_null_ids_of_long_pages(spark, tmp_path):
    long = "<p>many words</p>" * 9000
    rows = [(1, "u", long)] * 3 + [(2, "u", long), (3, "a", long + "x"), (3, "a", long + "y")] + [(None, "n", long + "z")] * 2 + [(None, "n", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.write_warc(df, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.status) for r in warc.read_warc(spark, path).collect())
    n = len(long)
    assert got == Counter({(1, n, "response", None, "ok"): 3, (2, n, "revisit", 1, "ok"): 1, (3, n + 1, "response", None, "ok"): 2, (None, n + 1, "response", None, "ok"): 2, (None, 0, "response", None, "ok"): 1})
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")).decode()
    ids = re.findall(r"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) and set(re.findall(r"WARC-Refers-To: (\S+)", text)) <= set(ids)
