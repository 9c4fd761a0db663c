"""Names and axes of array fields through pipelines, and models by the names of features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelathe.functions import spectral
from wavelathe.metadata import axis_of, carried, described, element, names_of
from wavelathe.operators import models
from wavelathe.plans import graph
from wavelathe.plans.long import _PAIRS


@pytest.fixture(scope="module")
def level(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(0, i, rng.normal(size=32).tolist()) for i in range(6)], "k int, vidx long, w array<double>")


def test_a_pipeline_keeps_and_reads_axes(level):
    spec = [
        {"type": "magnitude", "reads": ["in"], "writes": "mag", "options": {"rate": 16000, "size": 32}},
        {"type": "power_db", "reads": ["mag"], "writes": "db"},
        {"type": "spectral", "reads": ["mag"], "writes": "spec", "options": {"only": ["centroid"]}},
        {"type": "bands", "reads": ["mag"], "writes": "bands", "options": {"count": 6, "low": 500.0}},
        {"type": "vector", "reads": ["bands"], "writes": "log", "options": {"operation": "log"}},
        {"type": "scaled_axis", "reads": ["mag"], "writes": "axis", "options": {"points": 5, "scale": "mel", "low": 1000.0}},
    ]
    got = graph.build(spec, {"in": level}, keys=("k",))
    freqs = [500.0 * k for k in range(17)]
    assert axis_of(got["mag"], "w_mag") == freqs and axis_of(got["db"], "w_mag_db") == freqs
    tops = axis_of(got["bands"], "w_mag_bands")
    assert len(tops) == 6 and 500 < tops[0] < tops[-1] < 8000
    logs = got["log"].columns[-1]
    assert axis_of(got["log"], logs) == tops
    want = spectral.descriptors(F.col("w_mag"), freqs)["centroid"]
    a = [r[0] for r in got["mag"].orderBy("vidx").select(want).collect()]
    b = [r[0] for r in got["spec"].orderBy("vidx").select("w_mag_centroid").collect()]
    assert a == pytest.approx(b) and len(got["axis"].first()["w_mag_axis"]) == 5
    m = spectral.filterbank(17, 16000, 6, 500.0)
    assert np.allclose(spectral._hz_to("mel", tops), np.linspace(*spectral._hz_to("mel", [500.0, 8000.0]), 8)[1:-1]) and (m.argmax(1) > 0).all()
    with pytest.raises(ValueError, match="no axis"):
        graph.build([{"type": "spectral", "reads": ["in"], "writes": "out"}], {"in": level}, keys=("k",))


def test_names_are_found(level):
    named = described(described(level, "w", names=[f"n{i}" for i in range(32)]), "w", axis=range(32))
    assert names_of(named, "w")[3] == "n3" and axis_of(named, "w")[3] == 3.0
    further = carried(named.select("vidx", F.transform("w", lambda v: v * 2).alias("w_twice")), named)
    row = further.select(element(further, "n3").alias("a"), element(further, "w_twice[3]").alias("b"), element(further, "vidx").alias("c")).first()
    assert row["a"] == row["b"] == level.first()["w"][3] * 2 and row["c"] == 0
    with pytest.raises(ValueError, match="no field"):
        element(further, "n99")


def test_pair_models_by_name(spark):
    model = models.parse_pairs(_PAIRS)
    assert model["classes"] == ["low", "middle", "high"] and model["pairs"][1][2:4] == ([0.25, 0.5, -0.5], -12.0) and model["pairs"][2][4] == (-0.125, -0.125)
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.uniform(0, 100, 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, x_range double, x_amean double, x_max double")
    for r in models.pairs_class(df, model, True).collect():
        f = np.array([r["x_amean"], r["x_max"], r["x_range"]])
        votes = dict.fromkeys(model["classes"], 0)
        for a, b, w, bias, _ in model["pairs"]:
            votes[a if f @ np.array(w) + bias < 0 else b] += 1
        assert r["class"] == max(model["classes"], key=votes.get)
        assert sum(r[f"p_{c}"] for c in model["classes"]) == pytest.approx(1) and min(r[f"p_{c}"] for c in model["classes"]) >= 0
    for broken in (_PAIRS.replace("++END++", ""), _PAIRS.replace("3,low", "4,low"), _PAIRS.replace("BIAS: -12", "-12")):
        with pytest.raises(ValueError):
            models.parse_pairs(broken)
    with pytest.raises(ValueError, match="calibrations"):
        models.pairs_class(df, models.parse_pairs(_PAIRS.replace("##++LOGISTIC;0.5;-0.25\n", "")), True)
