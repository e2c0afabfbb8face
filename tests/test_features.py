import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions import categorical as cat
from clickloom.functions import heads
from clickloom.functions import images as im
from clickloom.operators import profile, resize, sampling, sparse
from clickloom.plans import image_prep
from clickloom.spec import Continuous, Cross, HashBucket, Identity, ModelSpec, embedding_width

SPEC = ModelSpec(
    ("clk", "id", "u", "tags", "kind", "age"),
    (
        HashBucket("u", 50),
        HashBucket("tags", 300),
        Identity("kind", 4),
        Continuous("age", "min_max", (0.0, 100.0), (20.0, 40.0)),
    ),
    (Cross(("u", "tags"), 1000), Cross(("kind", "age"), 64), Cross(("tags", "tags"), 200, deep=False)),
)

ROWS = [
    (0, "x", "p,q,p", 1, 20.0),
    (1, "", "p", 9, 19.9),
    (2, "y,z", "", -1, 55.0),
    (3, "x", "r,s", 3, None),
]


def md5_bucket(text, size):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size


def tokens(text):
    return [t for t in text.split(",") if t]


def expected_ids(row):
    """Ids per column, in spec order."""
    _, u, tags, kind, age = row
    us, ts = tokens(u), tokens(tags)
    kind = kind if 0 <= kind < 4 else 0
    bucket = 0 if age is None else sum(age >= b for b in (20, 40))
    return [
        [md5_bucket(t, 50) for t in us],
        [md5_bucket(t, 300) for t in ts],
        [kind],
        [bucket],
        [md5_bucket(a + "\u0001" + b, 1000) for a in us for b in ts],
        [md5_bucket(f"{kind}\u0001{bucket}", 64)],
        [md5_bucket(a + "\u0001" + b, 200) for a in ts for b in ts],
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, u string, tags string, kind int, age double")


def test_wide_ids(spark, rows):
    offsets = [s.offset for s in SPEC.wide_slots()]
    got = {r["id"]: r["ids"] for r in sparse.with_wide_ids(rows, SPEC, "md5").collect()}
    for row in ROWS:
        want = [i + o for ids, o in zip(expected_ids(row), offsets, strict=True) for i in ids]
        assert sorted(got[row[0]]) == sorted(want)
        assert all(0 <= i < SPEC.wide_dimension for i in want)


def test_wide_input_counts_repeats(spark, rows):
    offsets = [s.offset for s in SPEC.wide_slots()]
    got = {}
    for r in sparse.wide_input(rows, SPEC, ["id"], "md5").collect():
        assert (r["id"], r["idx"]) not in got
        got[r["id"], r["idx"]] = r["value"]
    want = {}
    for row in ROWS:
        for ids, o in zip(expected_ids(row), offsets, strict=True):
            for i in ids:
                want[row[0], i + o] = want.get((row[0], i + o), 0) + 1.0
    assert got == want


@pytest.mark.parametrize("bound", [True, False])
def test_deep_input_with_several_embeddings(spark, rows, monkeypatch, bound):
    if not bound:
        monkeypatch.setattr("clickloom.operators.lookup.BROADCAST_ROWS", 0)
    columns = {c.name: c for c in [*SPEC.features, *SPEC.crosses]}
    slots = SPEC.deep_slots()
    tables = {}
    for number, slot in enumerate(slots):
        if slot.how == "embedding":
            vector = F.array(*[(F.col("id") * 7 + d * 3 + number) % 11 / 4.0 for d in range(slot.width)])
            tables[slot.name] = spark.range(columns[slot.name].size).select(F.col("id").alias("idx"), vector.alias("vector"))
    got = {r["id"]: r["deep"] for r in sparse.deep_input(rows, SPEC, "id", tables, "md5").collect()}
    ids_of = dict(zip([c.name for c in [*SPEC.features, *SPEC.crosses]], range(7), strict=True))
    for row in ROWS:
        want = []
        for number, slot in enumerate(slots):
            ids = expected_ids(row)[ids_of[slot.name]]
            if slot.how == "number":
                want.append((row[4] or 0.0) / 100)
            elif slot.how == "hot":
                want += [float(ids.count(i)) for i in range(slot.width)]
            else:
                vectors = [[(i * 7 + d * 3 + number) % 11 / 4.0 for d in range(slot.width)] for i in ids]
                want += np.mean(vectors, axis=0).tolist() if vectors else [0.0] * slot.width
        assert len(got[row[0]]) == SPEC.deep_dimension
        np.testing.assert_allclose(got[row[0]], want)


def test_vocabulary_and_hot_vectors(spark):
    df = spark.createDataFrame([("a,c,a,zz",), ("",)], "t string")
    ids = cat.vocab_id_tokens(F.split("t", ","), ["a", "b", "c"])
    got = [tuple(r) for r in df.select(ids, cat.multi_hot(ids, 3), cat.one_hot(F.get(ids, 1), 3)).collect()]
    assert got[0] == ([0, 2, 0], [2.0, 0.0, 1.0], [0.0, 0.0, 1.0])
    assert got[1][:2] == ([], [0.0, 0.0, 0.0])


def test_bucket_edges(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (20.0,), (None,)], "x double")
    assert [r[0] for r in df.select(cat.bucketize(F.col("x"), [10.0, 20.0])).collect()] == [0, 1, 2, 0]


def test_collisions_approach_the_expected_share(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("v"))
    ratio = profile.hash_collisions(df, ["v"]).first()["bucket_ratio"]
    assert ratio == pytest.approx(1 - np.exp(-1), abs=0.01)


def test_heads(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], -800.0), ([700.0, 0.0, -700.0], 800.0)], "s array<double>, z double")
    rows = df.select(
        heads.softmax(F.col("s")).alias("p"),
        heads.argmax(F.col("s")).alias("c"),
        heads.binary_probabilities(F.col("z")).alias("b"),
        heads.log_loss(F.col("z"), F.lit(1.0)).alias("l"),
    ).collect()
    np.testing.assert_allclose(rows[0]["p"], np.exp([1, 3, 3]) / np.exp([1, 3, 3]).sum())
    assert [r["c"] for r in rows] == [1, 0]
    assert [r["b"] for r in rows] == [[1.0, 0.0], [0.0, 1.0]]
    assert [r["l"] for r in rows] == [800.0, 0.0]
    with pytest.raises(ValueError):
        heads.joint_logit("wide", None, F.col("z"))


# --- images ---------------------------------------------------------------------------------------


def image_table(spark, shape, n=12, seed=0):
    data = np.random.default_rng(seed).uniform(0, 255, size=(n, *shape)).round(3)
    rows = [(i, img.ravel().tolist(), shape[0], shape[1]) for i, img in enumerate(data)]
    return spark.createDataFrame(rows, "row_id long, pixels array<double>, height int, width int"), data


def arrays(df, column="pixels"):
    return [r[column] for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize(("new_h", "new_w"), [(5, 4), (9, 11), (3, 11), (9, 4), (6, 7)])
def test_crop_or_pad(spark, new_h, new_w):
    df, data = image_table(spark, (6, 7, 3))
    got = arrays(df.withColumn("pixels", im.crop_or_pad(F.col("pixels"), 6, 7, 3, new_h, new_w)))
    for flat, img in zip(got, data, strict=True):
        cut = img[max(0, (6 - new_h) // 2) :][:new_h, max(0, (7 - new_w) // 2) :][:, :new_w]
        want = np.zeros((new_h, new_w, 3))
        top, left = (new_h - cut.shape[0]) // 2, (new_w - cut.shape[1]) // 2
        want[top : top + cut.shape[0], left : left + cut.shape[1]] = cut
        np.testing.assert_allclose(np.reshape(flat, want.shape), want)


@pytest.mark.parametrize("channels", [1, 3])
def test_flip_and_channels(spark, channels):
    df, data = image_table(spark, (4, 5, channels))
    for flat, img in zip(arrays(df.withColumn("pixels", im.flip(F.col("pixels"), 4, 5, channels))), data, strict=True):
        np.testing.assert_allclose(np.reshape(flat, img.shape), img[:, ::-1])


def test_planes_to_pixels_and_bytes(spark):
    data = np.random.default_rng(1).integers(0, 256, size=(3, 4, 5))
    df = spark.createDataFrame([(0, data.ravel().tolist()), (1, [])], "row_id long, p array<int>")
    packed = df.select("row_id", im.bytes_of(F.col("p")).alias("b"))
    assert bytes(packed.orderBy("row_id").first()["b"]) == data.astype(np.uint8).tobytes()
    unpacked = packed.select("row_id", im.pixels_of(F.col("b")).alias("p"))
    assert arrays(unpacked, "p") == [data.ravel().tolist(), []]
    moved = unpacked.where("row_id = 0").select("row_id", im.chw_to_hwc(F.col("p"), 4, 5, 3).alias("p"))
    np.testing.assert_array_equal(np.reshape(arrays(moved, "p")[0], (4, 5, 3)), data.transpose(1, 2, 0))


def test_crops_stay_inside_and_repeat(spark):
    df, data = image_table(spark, (6, 7, 2), n=60)
    random = im.random_crop(F.col("pixels"), F.col("height"), F.col("width"), 2, 4, 4, F.col("row_id"), seed=3)
    crops = arrays(df.withColumn("pixels", random))
    assert crops == arrays(df.repartition(5).withColumn("pixels", random))
    offsets = set()
    for flat, img in zip(crops, data, strict=True):
        found = [
            (y, x) for y in range(3) for x in range(4) if np.array_equal(np.reshape(flat, (4, 4, 2)), img[y : y + 4, x : x + 4])
        ]
        assert len(found) == 1
        offsets.add(found[0])
    assert len(offsets) == 12
    with pytest.raises(Exception, match="smaller than the window"):
        df.select(im.central_crop(F.col("pixels"), F.col("height"), F.col("width"), 2, 7, 4)).collect()


def test_standardize_has_a_floor(spark):
    df = spark.createDataFrame([(0, [5.0] * 4), (1, [0.0, 2.0, 4.0, 6.0])], "row_id long, pixels array<double>")
    got = arrays(df.withColumn("pixels", im.standardize(F.col("pixels"))))
    assert got[0] == [0.0] * 4
    np.testing.assert_allclose(got[1], (np.array([0, 2, 4, 6]) - 3) / np.std([0, 2, 4, 6]))


def sampled(img, new_h, new_w):
    """Bilinear resize, one output pixel at a time."""
    h, w, _ = img.shape
    out = np.zeros((new_h, new_w, img.shape[2]))
    for y in range(new_h):
        for x in range(new_w):
            fy, fx = y * h / new_h, x * w / new_w
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            dy, dx = fy - y0, fx - x0
            out[y, x] = (img[y0, x0] * (1 - dx) + img[y0, x1] * dx) * (1 - dy) + (img[y1, x0] * (1 - dx) + img[y1, x1] * dx) * dy
    return out


@pytest.mark.parametrize(("new_h", "new_w"), [(3, 5), (6, 7), (13, 9)])
def test_bilinear(spark, new_h, new_w):
    df, data = image_table(spark, (6, 7, 3))
    got = resize.resize_to(df, "pixels", F.col("height"), F.col("width"), 3, new_h, new_w)
    assert {(r["height"], r["width"]) for r in got.collect()} == {(new_h, new_w)}
    for flat, img in zip(arrays(got), data, strict=True):
        np.testing.assert_allclose(np.reshape(flat, (new_h, new_w, 3)), sampled(img, new_h, new_w))


def test_mixed_shapes_in_one_table(spark):
    a, da = image_table(spark, (4, 8, 3), n=5)
    b, db = image_table(spark, (9, 3, 3), n=5, seed=2)
    both = a.union(b.withColumn("row_id", F.col("row_id") + 5)).coalesce(1)
    got = {r["row_id"]: r for r in resize.aspect_resize(both, "pixels", F.col("height"), F.col("width"), 3, 6).collect()}
    for i, img in enumerate([*da, *db]):
        size = (6, 12) if i < 5 else (18, 6)
        assert (got[i]["height"], got[i]["width"]) == size
        np.testing.assert_allclose(np.reshape(got[i]["pixels"], (*size, 3)), sampled(img, *size))


def test_training_recipe(spark):
    df, data = image_table(spark, (8, 10, 3), n=20)
    means = (123.68, 116.78, 103.94)
    done = image_prep.prepare_for_train(df, 3, 7, 7, means, sides=(8, 12), seed=5)
    rows = done.orderBy("row_id").collect()
    for r, img in zip(rows, data, strict=True):
        got, found = np.reshape(r["pixels"], (7, 7, 3)) + np.array(means), False
        for side in range(8, 13):
            big = sampled(img, side, int(np.float32(10) * np.float32(side / 8)))
            for y in range(big.shape[0] - 6):
                for x in range(big.shape[1] - 6):
                    window = big[y : y + 7, x : x + 7]
                    found |= np.allclose(got, window) or np.allclose(got, window[:, ::-1])
        assert found
    assert [r["pixels"] for r in rows] == arrays(image_prep.prepare_for_train(df, 3, 7, 7, means, sides=(8, 12), seed=5))


def test_custom_recipe(spark):
    df, data = image_table(spark, (6, 5, 3), n=15)
    plain = arrays(image_prep.prepare_custom(df, 3, 6, 5, training=False))
    for flat, img in zip(plain, data, strict=True):
        np.testing.assert_allclose(flat, ((img - img.mean()) / img.std()).ravel())
    rows = arrays(image_prep.prepare_custom(df, 3, 6, 5, training=True, seed=2))
    for flat, img in zip(rows, data, strict=True):
        big = np.zeros((14, 13, 3))
        big[4:10, 4:9] = img
        found = False
        for y in range(9):
            for x in range(9):
                window = big[y : y + 6, x : x + 5]
                scaled = (window - window.mean()) / max(window.std(), 1 / np.sqrt(window.size))
                found |= np.allclose(flat, scaled.ravel()) or np.allclose(flat, scaled[:, ::-1].ravel())
        assert found


def test_widths_agree():
    widths = [s.width for s in SPEC.deep_slots() if s.how == "embedding"]
    assert widths == [embedding_width(n) for n in (50, 300, 1000, 64)]


def test_cross_size_advice_tells_combinations_apart(spark):
    df = spark.createDataFrame([("a", "b&c"), ("a&b", "c"), ("a", None), (None, "c"), ("", "c")], "x string, y string")
    (row,) = profile.cross_size_advice(df, [("x", "y")]).collect()
    assert (row["cross"], row["n_values"], row["product_size"], row["double_size"]) == ("x&y", 2, 4, 4)


def test_exact_sample_keeps_labels_other_than_one(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([0, 1, 2, None] * 3)], "id long, y int")
    assert sampling.downsample_exact(df, "y", "id", 1.0).count() == 12
    assert {r["y"] for r in sampling.downsample_exact(df, "y", "id", 0.0).collect()} == {1}
    assert sampling.downsample_exact(df, "y", "id", 0.5).count() == 3 + 5  # of the other nine rows


@pytest.mark.parametrize("bits", [1, 12])
def test_smallest_hashes_of_each_stratum(spark, monkeypatch, bits):
    monkeypatch.setattr(sampling, "SLICE_BITS", bits)
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"g{i % 7}", "x") for i in range(900)] + [(5, "hot", "twin")]
    df = spark.createDataFrame(rows, "id long, g string, n string")
    draw = lambda i: int(hashlib.md5(f"4:{i}".encode()).hexdigest()[:15], 16)
    want = []
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (draw(r[0]), r[0]))
        want += mine[: {None: 1000, "hot": 40}.get(g, 5)]
    size = F.when(F.col("g").isNull(), 1000).when(F.col("g") == "hot", 40).otherwise(5)
    for parts in (1, 5):
        got = [tuple(r) for r in sampling.bottom_k(df.drop("n").withColumn("x", F.lit("x")).repartition(parts), ["g"], "id", size, 4).collect()]
        assert sorted(got, key=str) == sorted(((r[0], r[1], "x") for r in want), key=str)
    assert sampling.bottom_k(df.where("false"), ["g"], "id", size).collect() == []


def test_null_images_stay_null(spark):
    df = spark.createDataFrame([(bytes([1, 255]),), (None,), (b"",)], "image binary")
    unpacked = df.coalesce(1).select(im.pixels_of(F.col("image")).alias("p"))
    assert [r[0] for r in unpacked.collect()] == [[1, 255], None, []]
    assert [r[0] and bytes(r[0]) for r in unpacked.select(im.bytes_of(F.col("p"))).collect()] == [bytes([1, 255]), None, b""]


def test_images_of_mixed_shapes_move_together(spark):
    rows = [(0, [1, 2, 3, 4, 5, 6, 7, 8], 2, 2), (1, [9, None, 11, 12], 1, 2), (2, None, 1, 1), (3, [1, 2], None, 1), (4, [1, 2, 3], 1, 2), (5, [], 0, 5), (6, [1, 2, 3, 4, 5, 6, 7, 8], 4, 1)]
    df = spark.createDataFrame(rows, "row_id long, p array<int>, h int, w int").coalesce(1)
    moved = df.select("row_id", im.chw_to_hwc(F.col("p"), F.col("h"), F.col("w"), 2).alias("p"))
    want = [[1, 5, 2, 6, 3, 7, 4, 8], [9, 11, None, 12], None, None, [1, 3, 2, None], [], [1, 5, 2, 6, 3, 7, 4, 8]]
    assert arrays(moved, "p") == want
    assert arrays(moved.where("row_id <> 0").limit(3), "p") == want[1:4]
    floats = df.select("row_id", im.chw_to_hwc(F.transform("p", lambda x: x / 2), F.col("h"), F.col("w"), 2, "double").alias("p"))
    assert arrays(floats, "p")[0] == [0.5, 2.5, 1.0, 3.0, 1.5, 3.5, 2.0, 4.0]


def test_pixels_that_are_no_bytes_are_refused(spark):
    for bad in ([256], [-1], [None]):
        with pytest.raises(Exception, match="pixel"):
            spark.createDataFrame([(bad,)], "p array<int>").select(im.bytes_of(F.col("p"))).collect()
