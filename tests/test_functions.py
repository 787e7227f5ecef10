"""Equations against textbook values, limits and inverses; scalar functions against examples."""

import math

import pytest
from pyspark.sql import functions as F

from corelode.functions import petro as P
from corelode.functions import scalars as S


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def value(c, **columns):
        return frame.select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("_")).select(c).first()[0]

    return value


def test_shale_volume(one):
    assert one(P.vshale(P.col(75.0), 20, 130)) == pytest.approx(0.5)
    assert one(P.vshale(P.col(300.0), 20, 130)) == 1.0
    assert one(P.vshale(P.col(None), 20, 130)) is None
    assert one(P.vshale(P.col(50.0), 30, 30)) is None
    for method in ("linear", "larionov_tertiary", "larionov_older", "clavier"):
        assert one(P.vshale(P.col(20.0), 20, 130, method)) == pytest.approx(0.0, abs=0.01)
        assert one(P.vshale(P.col(130.0), 20, 130, method)) == pytest.approx(1.0, abs=0.02)
    with pytest.raises(ValueError, match="unknown"):
        P.vshale_of_index(0.5, "other")


def test_shale_volume_sp_deflects_both_ways(one):
    assert one(P.vshale_sp(P.col(-40.0), -80, 0)) == pytest.approx(0.5)
    assert one(P.vshale_sp(P.col(40.0), 80, 0)) == pytest.approx(0.5)


def test_porosity(one):
    assert one(P.porosity_density(P.col(2.368))) == pytest.approx(0.2)
    assert one(P.porosity_neutron_density(P.col(0.3), P.col(0.1))) == pytest.approx(0.2)
    assert one(P.porosity_neutron_density(P.col(0.3), P.col(0.1), "rms")) == pytest.approx(math.sqrt(0.05))
    assert one(P.porosity_neutron_density(P.col(None), P.col(0.1))) == pytest.approx(0.1)
    assert one(P.porosity_sonic(P.col(55.5))) == 0.0
    assert one(P.porosity_sonic(P.col(-1.0))) is None


def test_saturation(one):
    assert one(P.saturation_archie(P.col(20.0), P.col(0.2), 0.05)) == pytest.approx(0.25)
    assert one(P.saturation_archie(P.col(0.0), P.col(0.2), 0.05)) is None
    rt = one(P.pickett_resistivity(P.col(0.2), P.col(0.25), 0.05))
    assert one(P.saturation_archie(P.col(rt), P.col(0.2), 0.05)) == pytest.approx(0.25)
    sw = one(P.saturation_simandoux(P.col(8.0), P.col(0.2), 0.05, P.col(0.3), P.col(4.0)))
    assert 1 / 8 == pytest.approx(0.2**2 * sw**2 / 0.05 + 0.3 * sw / 4)
    assert one(P.saturation_simandoux(P.col(20.0), P.col(0.2), 0.05, P.col(0.0), P.col(4.0))) == pytest.approx(0.25)
    assert one(P.saturation_index(P.col(16.0), 4.0)) == pytest.approx(0.5)


def test_temperature_and_brine(one):
    assert one(P.temperature(P.col(5000.0), 60, 160, 10000)) == pytest.approx(110)
    assert one(P.temperature(P.col(5000.0), 60, None, 10000)) is None
    assert one(P.water_resistivity(0.05, 75, P.col(75.0))) == pytest.approx(0.05)


def test_organic_carbon(one):
    assert one(P.organic_carbon(P.delta_log_r(P.col(50.0), 5.0, P.col(2.5), 2.5), 10)) == pytest.approx(10 ** (2.297 - 1.688))
    assert one(P.organic_carbon(P.col(-1.0))) == 0.0


def test_clamp_keeps_nulls_and_flags_are_never_null(one):
    assert one(P.clamp(P.col(None), 0, 1)) is None
    assert one(P.bad_hole(P.col(None), P.col(8.5))) is False
    assert one(P.bad_hole(P.col(8.0), P.col(8.5), P.col(-0.2))) is True


def test_lithology(one):
    cases = {(0.1, None): "sandstone", (0.5, None): "siltstone", (0.7, None): "shale", (0.1, 5.0): "limestone", (0.6, 3.6): "marl", (0.1, 3.0): "siltstone", (0.1, 2.0): "sandstone", (0.5, 5.0): "marl", (0.8, 5.0): "shale", (None, 5.0): None}
    for (v, p), want in cases.items():
        assert one(P.quick_lithology(P.col(v), P.col(p))) == want


def test_coordinates(one):
    assert one(S.coordinate(F.lit("41.31"))) == pytest.approx(41.31)
    assert one(S.coordinate(F.lit("041° 02' 31.04\" N"))) == pytest.approx(41 + 2 / 60 + 31.04 / 3600)
    assert one(S.coordinate(F.lit("104 26 37.66 W"))) == pytest.approx(-(104 + 26 / 60 + 37.66 / 3600))
    assert one(S.coordinate(F.lit("-104.4438"))) == pytest.approx(-104.4438)
    assert one(S.coordinate(F.lit("none"))) is None
    assert one(S.western_longitude(P.col(104.4), P.col(41.0))) == -104.4


def test_api_numbers(one):
    assert one(S.api_identity(F.lit("47-061-01812-00-03"))["key"]) == "4706101812-00"
    assert one(S.api_identity(F.lit("4706101812"))["key"]) == "4706101812-00"
    assert one(S.api_identity(F.lit("049-021-12345-01"))["key"]) == "4902112345-01"
    assert one(S.api_identity(F.lit("UWI 7X"))["us"]) is False
    assert one(S.api_identity(F.lit(""))) is None
    assert one(S.clean_api(F.lit("403712345"))) == "0403712345"
    assert one(S.format_api(S.api_identity(F.lit("470610181201")))) == "47-061-01812-01"


def test_dates(one):
    for text, want in {"2021-4-2": "2021-04-02", "4/22/2021": "2021-04-22", "22-Apr-2021": "2021-04-22", "1 March 2020": "2020-03-01", "44308": "2021-04-22", "about 1980": "about 1980", "13/13/2020": "13/13/2020"}.items():
        assert one(S.clean_date(F.lit(text))) == want


def test_same_values(one):
    assert one(S.same_value("num", F.lit("5000.01"), F.lit("5000.05")))
    assert not one(S.same_value("num", F.lit("5000"), F.lit("5001")))
    assert one(S.same_value("text", F.lit("Honor  Rancho"), F.lit("honor rancho, Los Angeles")))
    assert not one(S.same_value("text", F.lit("a"), F.lit("b")))
    assert one(S.same_value("api", F.lit("4706101812"), F.lit("47-061-01812-01")))
    assert not one(S.same_value("api", F.lit("470610181202"), F.lit("47-061-01812-01")))


def test_text_numbers_and_units(one):
    assert one(S.plain_number(F.lit("1,250.5 ft"))) == 1250.5
    assert one(S.plain_number(F.lit("12.5S"))) == -12.5
    assert one(S.label_number(F.lit("1,250 ft"))) == 1250.0
    assert one(S.label_number(F.lit("GR 1250"))) is None
    assert one(S.to_double(F.lit("NaN"))) is None
    assert one(S.length_unit(F.lit("Top (ft MD)"))) == "ft"
    assert one(S.convert_length(P.col(1.0), F.lit("m"), "ft")) == pytest.approx(1 / 0.3048)
    assert one(S.header_name_unit(F.lit("Bulk density (g/cc)"))[0]) == "BULK_DENSITY"
    assert one(S.nice_step(P.col(87.0))) == pytest.approx(10.0)
    assert one(S.half_unit(P.col(10.3))) == 10.5
    lat, lon = S.position_pair(F.lit("41.1234, -104.5678"))
    assert (one(lat), one(lon)) == (41.1234, -104.5678)


def test_geodesy(one):
    assert one(S.haversine_km(P.col(0.0), P.col(0.0), P.col(0.0), P.col(90.0))) == pytest.approx(12742 * math.pi / 4)
    lat, lon = S.nad27_to_wgs84(P.col(40.0), P.col(-105.0))
    assert abs(one(lat) - 40.0) < 1e-3 and 1e-4 < abs(one(lon) + 105.0) < 1e-3


def test_minus_zero_degrees_and_serial_dates(spark):
    rows = [("-0°30'", -0.5, "-0°30'"), ("10000.5", 10000.5, "10000.5"), ("44308", 44308.0, "2021-04-22"), ("22 April, 2021", 22.0, "2021-04-22"), ("31-Feb-2021", 31.0, "31-Feb-2021")]
    got = spark.createDataFrame([(t,) for t, *_ in rows], "t string").select("t", S.coordinate("t").alias("c"), S.clean_date("t").alias("d")).collect()
    assert [tuple(r) for r in got] == rows
