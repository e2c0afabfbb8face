"""Build a spec from parsed configuration mappings (the YAML layout users already have)."""

from __future__ import annotations

from collections.abc import Mapping

from clickloom.spec.model import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab

DEFAULT_CROSS_THOUSANDS = 10


def spec_from_config(schema: Mapping, features: Mapping, crosses: Mapping | None = None, multivalue: bool = True) -> ModelSpec:
    """``schema`` maps position to field name; ``features`` and ``crosses`` map names to settings."""
    fields = tuple(str(schema[i]).lower() for i in sorted(schema))
    used = tuple(_feature(name.lower(), settings) for name, settings in features.items())
    crossed = tuple(_cross(name, settings or {}) for name, settings in (crosses or {}).items())
    return ModelSpec(fields, used, crossed, multivalue)


def spec_from_yaml(schema_path: str, feature_path: str, cross_path: str | None = None, multivalue: bool = True) -> ModelSpec:
    """Same, from YAML files; needs the optional ``yaml`` package."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml package; use spec_from_config instead") from missing

    def load(path):
        with open(path, encoding="utf-8") as handle:
            return yaml.safe_load(handle)

    return spec_from_config(load(schema_path), load(feature_path), load(cross_path) if cross_path else None, multivalue)


def _feature(name: str, settings: Mapping):
    kind, transform, parameter = settings["type"], settings.get("transform"), settings.get("parameter")
    match kind, transform:
        case "category", "hash_bucket":
            return HashBucket(name, int(parameter))
        case "category", "vocab":
            return Vocab(name, tuple(str(v) for v in parameter))
        case "category", "identity":
            return Identity(name, int(parameter))
        case "continuous", _:
            parameter = parameter or {}
            pair = parameter.get("normalization")
            return Continuous(
                name,
                transform or None,
                None if not pair or transform == "log" else (float(pair[0]), float(pair[1])),
                tuple(float(b) for b in parameter.get("boundaries") or ()),
            )
    raise ValueError(f"{name}: unknown type {kind!r} with transform {transform!r}")


def _cross(name: str, settings: Mapping) -> Cross:
    members = tuple(part.strip().lower() for part in name.split("&"))
    thousands = settings.get("hash_bucket_size") or DEFAULT_CROSS_THOUSANDS
    deep = settings.get("is_deep")
    return Cross(members, int(1000 * thousands), True if deep is None else bool(deep))
