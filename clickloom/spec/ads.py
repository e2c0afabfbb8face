"""The ad-log spec: 61 fields, 39 used features, 31 crosses."""

from __future__ import annotations

from clickloom.spec.model import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab

# Field names in file order, label first.
FIELDS = [
    "clk", "request_id", "account_id", "adplan_id", "scheduling_id", "position_id", "idea_id", "cost_type",
    "province_id", "city_id", "ip_original", "os", "device_type", "client_type", "galaxy_id", "network",
    "app_version", "idea_type", "tag", "industry_level1_id", "industry_level2_id", "category", "location",
    "isweekend", "weekdays", "year", "month", "day", "hour", "dt", "host_name", "request_tm", "log_version", "pay",
    "ecpm", "ecpm2", "winprc", "ctr", "rpid", "u", "market", "site", "status", "is_cache", "ctr_strategy_type",
    "is_pasv_flush", "isp", "combine_id", "device_model", "article_tag", "longitude", "latitude", "user_cates",
    "user_industrys", "ad_cates", "ad_idea_types", "age", "ugender", "ucomp", "rk_age_range", "rk_hour",
]

# Ids per hashed field.
HASH_SIZES = {
    "adplan_id": 10000, "scheduling_id": 10000, "idea_id": 20000, "province_id": 100, "city_id": 1000,
    "ip_original": 500000, "app_version": 100, "category": 500, "u": 10000000, "device_model": 10000,
    "article_tag": 500, "user_cates": 1000, "user_industrys": 1000, "ad_cates": 1000, "ad_idea_types": 100,
    "ucomp": 1000,
}

# Closed value lists.
VOCABULARIES = {
    "os": ("0", "1", "2", "3", "4", "5"),
    "device_type": ("0", "1", "2"),
    "client_type": ("a", "w"),
    "network": ("0", "1", "2", "3", "4"),
    "location": (
        "1", "2", "3", "4", "5", "6", "7", "8", "9", "20", "21", "22", "23", "24", "25", "26", "27", "28", "29",
        "50", "51", "52", "53", "54", "60", "101", "102", "200", "201", "202", "301", "302", "303", "304", "1001",
        "1002", "2001", "2002", "3001", "3002", "4001", "4002", "5001", "5002", "6001", "6002", "7001", "7002",
        "8001", "8002", "9001", "10001", "10002", "11001", "11002",
    ),
    "isweekend": ("0", "1"),
    "weekdays": ("1", "2", "3", "4", "5", "6", "7"),
    "day": (
        "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13", "14", "15", "16", "17", "18",
        "19", "20", "21", "22", "23", "24", "25", "26", "27", "28", "29", "30", "31",
    ),
    "hour": (
        "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18",
        "19", "20", "21", "22", "23",
    ),
    "site": ("1", "2", "3", "4", "5", "6", "8", "9", "10", "11"),
    "status": ("0", "1", "2", "3"),
    "is_cache": ("0", "1"),
    "is_pasv_flush": ("0", "1"),
    "isp": ("1", "2", "3", "4"),
    "ugender": ("male", "female"),
    "rk_age_range": ("6-10", "11-15", "16-20", "21-25", "26-30", "31-35", "36-40", "41-45", "46-50", "51-55", "56-60"),
    "rk_hour": (
        "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18",
        "19", "20", "21", "22", "23",
    ),
}

# Number of ids per integer category.
IDENTITY_SIZES = {"idea_type": 15, "industry_level1_id": 18, "industry_level2_id": 152}

# Range for min-max scaling and bucket boundaries.
NUMBERS = {
    "longitude": ((80, 150), (90, 95, 100, 105, 110, 115, 120, 125, 130)),
    "latitude": ((10, 60), (20, 25, 30, 35, 40, 45, 50)),
    "age": ((10, 90), (15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65)),
}

# Crosses and their ids, in thousands.
CROSS_THOUSANDS = {
    "adplan_id&category": 100, "category&ucomp": 10, "scheduling_id&ucomp": 100, "category&location&site": 100,
    "age&ugender": 0.1, "scheduling_id&age": 10, "site&age&ugender": 1, "industry_level2_id&age&ugender": 3,
    "scheduling_id&age&ugender": 100, "industry_level2_id&ucomp": 10, "adplan_id&ucomp": 100,
    "adplan_id&category&ucomp": 1000, "category&scheduling_id": 100, "category&industry_level2_id": 10,
    "category&network&os": 10, "hour&weekdays": 1, "hour&scheduling_id": 10, "hour&industry_level2_id": 10,
    "network&os&site": 1, "industry_level2_id&site": 1, "adplan_id&os&site": 100,
    "industry_level2_id&network&os": 10, "network&os&scheduling_id": 100, "industry_level2_id&user_industrys": 30,
    "industry_level2_id&ip_original": 100, "city_id&industry_level2_id": 10, "idea_type&os&network": 1,
    "idea_id&site&category": 100, "idea_type&city_id": 10, "idea_id&province_id": 10, "idea_id&device_type&os": 10,
}


def ads_spec(crosses: bool = True) -> ModelSpec:
    features = [HashBucket(name, size) for name, size in HASH_SIZES.items()]
    features += [Vocab(name, values) for name, values in VOCABULARIES.items()]
    features += [Identity(name, size) for name, size in IDENTITY_SIZES.items()]
    features += [
        Continuous(name, "min_max", tuple(map(float, limits)), tuple(map(float, bounds)))
        for name, (limits, bounds) in NUMBERS.items()
    ]
    crossed = [Cross(tuple(name.split("&")), int(1000 * k)) for name, k in CROSS_THOUSANDS.items()]
    return ModelSpec(tuple(FIELDS), tuple(features), tuple(crossed) if crosses else ())
