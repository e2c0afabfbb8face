import pytest

from clickloom.spec import Continuous, Cross, HashBucket, ModelSpec, embedding_width
from clickloom.spec.ads import ads_spec
from clickloom.spec.config import spec_from_config


def test_shipped_dimensions():
    spec = ads_spec()
    assert (len(spec.fields), len(spec.features), len(spec.crosses)) == (61, 39, 31)
    assert sorted(len(c.members) for c in spec.crosses).count(2) == 18
    assert (len(spec.wide_slots()), spec.wide_dimension) == (70, 12_714_809)
    assert (len(spec.deep_slots()), spec.deep_dimension) == (70, 734)
    plain = ads_spec(crosses=False)
    assert (plain.wide_dimension, plain.deep_dimension) == (10_556_709, 502)


def test_embedding_widths():
    assert [embedding_width(n) for n in (100, 1000, 10_000, 500_000, 10_000_000)] == [4, 4, 8, 16, 32]


def test_wide_slots_do_not_overlap():
    end = 0
    for slot in ads_spec().wide_slots():
        assert slot.offset == end
        end += slot.size


def test_names_by_role():
    spec = ads_spec()
    assert len(spec.names("all")) == 60 and "clk" not in spec.names("all")
    assert len(spec.names("used")) + len(spec.names("unused")) == 60
    assert spec.names("continuous") == ["longitude", "latitude", "age"]
    assert len(spec.names("category")) == 36
    assert [spec.field_type(n) for n in ("clk", "idea_type", "age", "os", "pay")] == ["int", "int", "float", "string", "string"]


def test_config_layout():
    spec = spec_from_config(
        {1: "CLK", 2: "User", 3: "Age", 4: "OS", 5: "kind"},
        {
            "user": {"type": "category", "transform": "hash_bucket", "parameter": 100},
            "age": {
                "type": "continuous",
                "transform": "log",
                "parameter": {"normalization": [1, 2], "boundaries": [10, 20]},
            },
            "os": {"type": "category", "transform": "vocab", "parameter": [0, 1]},
            "kind": {"type": "category", "transform": "identity", "parameter": 7},
        },
        {"user&age": {"hash_bucket_size": 0.1, "is_deep": 0}, "user&os": {"hash_bucket_size": None, "is_deep": None}},
    )
    assert spec.fields == ("clk", "user", "age", "os", "kind")
    assert spec.feature("age").params is None
    assert spec.feature("os").values == ("0", "1")
    assert [(c.size, c.deep) for c in spec.crosses] == [(100, False), (10_000, True)]


def test_yaml_files(tmp_path):
    pytest.importorskip("yaml")
    from clickloom.spec.config import spec_from_yaml

    (tmp_path / "schema.yaml").write_text("1: clk\n2: u\n")
    (tmp_path / "feature.yaml").write_text("u:\n  type: category\n  transform: hash_bucket\n  parameter: 10\n")
    spec = spec_from_yaml(str(tmp_path / "schema.yaml"), str(tmp_path / "feature.yaml"))
    assert spec.wide_dimension == 10


@pytest.mark.parametrize(
    "build",
    [
        lambda: ModelSpec(("clk",), (HashBucket("u", 10),)),
        lambda: ModelSpec(("clk", "u"), (HashBucket("u", 10),), (Cross(("u", "v")),)),
        lambda: ModelSpec(("clk", "u", "x"), (HashBucket("u", 10), Continuous("x")), (Cross(("u", "x")),)),
        lambda: Cross(("u",)),
        lambda: Continuous("x", "min_max"),
        lambda: Continuous("x", "cube"),
        lambda: Continuous("x", None, None, (3.0, 1.0)),
    ],
)
def test_invalid_specs(build):
    with pytest.raises(ValueError):
        build()
