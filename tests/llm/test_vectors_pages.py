import base64
import hashlib

import numpy as np
import zstandard

from logloom.llm import embeddings, warc


def brute_links(rows, threshold=0.98):
    """n_links and component by all pairs, in double precision."""
    fine = [(i, n, label, np.array(v, float)) for n, (i, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {n: 0 for n in range(len(rows))}, {n: n for n in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fine)):
        for b in range(a):
            x, y = fine[a][3], fine[b][3]
            if fine[a][2] == fine[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[fine[a][1]] += 1
                links[fine[b][1]] += 1
                root[find(fine[a][1])] = find(fine[b][1])
    groups = {}
    for n in root:
        groups.setdefault(find(n), []).append(rows[n][0])
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[n][0], links[n], least[find(n)]) for n in root), key=repr)


def got(df, **options):
    found = embeddings.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(df) == brute_links([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_clusters_over_tiles(spark):
    """Tight clusters, exact copies, multiples and near misses, in tiles of a few vectors."""
    rng, rows = np.random.default_rng(5), []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            v = (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2])) * rng.choice([1.0, 3.0, 1e-3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows)
    for tile in (7, 64, 2048):
        assert got(df, tile=tile) == want


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 1500))
    a = embeddings.Vectors(x)
    near = embeddings.products(a.q, a.q) * a.scale[:, None] * a.scale[None, :]
    assert (embeddings.products(a.q, a.q) == a.q.astype(np.int64) @ a.q.astype(np.int64).T).all()
    assert (np.abs(near - a.unit @ a.unit.T) <= a.error[:, None] * a.length[None, :] + a.error[None, :] + embeddings.SLACK).all()


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, -0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [inf, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [], 1), (10, [1.0], 1), (11, [1.0, 0.0], 2), (1, [1.0, 0.0], 1), (None, [3.0, 0.0], 1), (12, [3e38, 1e30], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    assert got(df) == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_archives(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, "http://x/\r\ny%0A", "same é\r\n\r\nWARC/1.1"), (9002, None, "same é\r\n\r\nWARC/1.1"), (9003, "u", None), (9004, "u", "")], "page_id long, url string, html string")
    df = pages.unionByName(extra)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder)
    records = {r.page_id: r for r in warc.read_archives(index).collect()}
    rows, first = {r.page_id: r for r in df.collect()}, {}
    for i in sorted(rows):
        first.setdefault(rows[i].html or "", i)
    assert set(records) == set(rows)
    for i, r in records.items():
        body = (rows[i].html or "").encode()
        leader = first[rows[i].html or ""]
        assert r.url == rows[i].url and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to, bytes(r.payload)) == (("response", None, body) if leader == i else ("revisit", leader, b""))
    for row in index.limit(20).collect():
        data = warc.read_record(row.asDict())
        assert row.record_id.encode() in data and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    # A bundle is plain Zstandard: a reader that knows nothing of frames gets all records in order.
    path = index.first().bundle.removeprefix("file://")
    with open(path, "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert len([*warc.parsed(whole)]) == index.where(index.bundle == index.first().bundle).count()
    sizes = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.resolved(warc.read_archives(index)).collect()}
    assert sizes[9002] == (len("same é\r\n\r\nWARC/1.1".encode()), "revisit") and sizes[9004] == (0, "revisit")


def test_small_payloads_stay_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "abcdef"), (None, "u", "lone"), (3, "u", "abcdef")], "page_id long, url string, html string")
    index = warc.write_archives(df, f"file://{tmp_path}/w", least=3)
    found = [(r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(index).collect()]
    want = [(0, "response", None), (0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert [r.record_type for r in warc.read_archives(index).collect() if r.page_id == 3] == ["response", "response"]
    assert warc.write_archives(df.limit(0), f"file://{tmp_path}/e").count() == 0
