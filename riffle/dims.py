"""Rivers, gauges, sections, and the formulas that derive section levels from gauges.

The tables are tiny and fixed, and handed to Spark as local relations.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riffle import schemas

# River names, gauge registry, section thresholds, links and level formulas.

# river_id, river_name
RIVER_ROWS = [
    (1, "Main Payette"),
    (2, "South Fork Payette"),
    (3, "Middle Fork Payette"),
    (4, "North Fork Payette"),
    (5, "Deadwood"),
    (6, "Main Salmon"),
    (7, "Little Salmon"),
    (8, "Lochsa"),
    (9, "Boise"),
    (10, "Middle Fork Owyhee"),
    (11, "Middle Fork Salmon"),
    (12, "Murtaugh"),
    (13, "Bruneau"),
    (14, "South Fork Salmon"),
]

# gauge_id, gauge_name, river_id, usgs, reclamation and noaa identifiers, observed_api, forecast_api, lat, lon
GAUGE_ROWS = [
    (
        1, "Lochsa River near Lowell, ID", 8,
        "USGS-13337000", None, "13337000", "waterdata_usgs", "noaa", 46.1446, -115.5982,
    ),
    (
        2, "Payette River near Horseshoe Bend, ID", 1,
        "USGS-13247500", None, "13247500", "waterdata_usgs", "noaa", 43.9146, -116.1954,
    ),
    (
        3, "North Fork Payette River at Banks, ID", 4,
        "USGS-13246000", None, "13246000", "waterdata_usgs", "noaa", 44.0813, -116.1267,
    ),
    (
        4, "South Fork Payette River at Lowman, ID", 2,
        "USGS-13235000", None, "13235000", "waterdata_usgs", "noaa", 44.0835, -115.6254,
    ),
    (
        5, "Deadwood River below Deadwood Reservoir near Lowman, ID", 5,
        "USGS-13236500", None, "13236500", "waterdata_usgs", "noaa", 44.3066, -115.655,
    ),
    (
        6, "Middle Fork Payette River near Crouch, ID", 3,
        "USGS-13237920", None, "13237920", "waterdata_usgs", "noaa", 44.1152, -115.9684,
    ),
    (
        7, "Boise River at Glenwood Bridge near Boise, ID", 9,
        "USGS-13206000", None, "13206000", "waterdata_usgs", "noaa", 43.6596, -116.2807,
    ),
    (
        8, "Salmon River at White Bird, ID", 6,
        "USGS-13317000", None, "13317000", "waterdata_usgs", "noaa", 45.7563, -116.3082,
    ),
    (
        9, "Little Salmon River at Riggins, ID", 7,
        "USGS-13316500", None, "13316500", "waterdata_usgs", "noaa", 45.4216, -116.315,
    ),
    (
        10, "Middle Fork Salmon River near Yellow Pine, ID", 11,
        "USGS-13309220", None, "13309220", "waterdata_usgs", "noaa", 44.9626, -115.4973,
    ),
    (
        11, "Snake River at Milner, ID", 12,
        "USGS-13087995", None, "13087995", "waterdata_usgs", "noaa", 42.5285, -114.024,
    ),
    (
        12, "Owyhee River near Rome, OR", 10,
        "USGS-13181000", None, "13181000", "waterdata_usgs", "noaa", 42.856, -117.633,
    ),
    (
        13, "North Fork Payette River at Cascade, ID", 4,
        None, "CSCI", "CSDI1", "bureau_reclamation", "noaa", 44.5248931741067, -116.046798314511,
    ),
    (
        14, "Bruneau River at Hot Springs", 13,
        "USGS-13168500", None, "13168500", "waterdata_usgs", "noaa", 42.7711, -115.719,
    ),
    (
        15, "South Fork Salmon River at Krassel Ranger Station", 14,
        "USGS-13310700", None, "13310700", "waterdata_usgs", "noaa", 44.9869, -115.725,
    ),
]

# section_id, river_id, section, section_name, flow_unit, min, medium, high and max level, lat, lon, guide, state, links, videos
SECTION_ROWS = [
    (
        1, 1, "main_payette", "The Main", "cfs", 1500.0,
        4000.0, 8000.0, 15000.0, 44.08439, -116.11632,
        "https://www.americanwhitewater.org/content/River/view/river-detail/4360/main",
        "Idaho",
        None,
        None,
    ),
    (
        2, 1, "lower_payette", "Lower Main", "cfs", 1500.0,
        4000.0, 8000.0, 15000.0, 44.00588, -116.17994,
        "https://www.americanwhitewater.org/content/River/view/river-detail/4156/main",
        "Idaho",
        None,
        None,
    ),
    (
        3, 1, "lower_payette_climax", "Climax Wave", "cfs", 2500.0,
        4000.0, 6000.0, 7000.0, 43.9418, -116.19629,
        "https://www.americanwhitewater.org/content/River/view/river-detail/4156/main",
        "Idaho",
        None,
        None,
    ),
    (
        4, 1, "payette_gutter", "The Gutter", "cfs", 800.0,
        3000.0, 4500.0, 6500.0, 43.90865, -116.19005,
        "https://www.americanwhitewater.org/content/River/view/river-detail/587/main",
        "Idaho",
        None,
        None,
    ),
    (
        5, 4, "nf_payette_warm_up", "The Warm Up", "cfs", 1450.0,
        1500.0, 1600.0, 1800.0, 44.140075300847975, -116.11551982370194,
        "https://www.americanwhitewater.org/content/River/view/river-detail/592/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=F4wAC3s0Qaw",
            "https://www.youtube.com/watch?v=T2FY2ngnxc0",
            "https://www.youtube.com/watch?v=KQUpsJBmuzs",
            "https://www.youtube.com/watch?v=cn83x4cpqAs",
            "https://www.youtube.com/watch?v=5E5fw_D3Z0Y",
        ],
    ),
    (
        6, 2, "sf_payette_grandjean", "Grandjean", "cfs", 1800.0,
        2500.0, 3000.0, 6000.0, 44.15495779938454, -115.16628540704463,
        "https://www.americanwhitewater.org/content/River/view/river-detail/593/main",
        "Idaho",
        None,
        None,
    ),
    (
        7, 2, "sf_payette_kirkham", "Kirkham", "cfs", 1800.0,
        2500.0, 3000.0, 6000.0, 44.09144740077549, -115.47284235254644,
        "https://www.americanwhitewater.org/content/River/view/river-detail/593/main",
        "Idaho",
        None,
        None,
    ),
    (
        8, 2, "sf_payette_canyon", "The Canyon", "cfs", 330.0,
        2000.0, 4000.0, 6500.0, 44.08083, -115.65782,
        "https://www.americanwhitewater.org/content/River/view/river-detail/594/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=qBshWXJ54CA",
        ],
    ),
    (
        9, 14, "sf_salmon", "South Fork Salmon", "feet", 2.5,
        3.5, 5.0, 7.0, 45.025750972341534, -115.70752924991736,
        "https://www.americanwhitewater.org/content/River/view/river-detail/621/main",
        "Idaho",
        [
            "https://www.cacreeks.com/mfsfsalm.htm",
            "https://www.oregonkayaking.net/rivers/sf_salmon_wilderness/sf_salmon_wilderness.html",
            "https://www.whitewaterguidebook.com/idaho/south-fork-salmon-river/",
        ],
        [
            "https://www.youtube.com/watch?v=Ufna2nbXVjo",
            "https://www.youtube.com/watch?v=NXGSq6XS0c4",
            "https://www.youtube.com/watch?v=uZoslej2xjM",
            "https://www.youtube.com/watch?v=elx8Z9RNZkw",
            "https://www.youtube.com/watch?v=Wwbfz8lj0ow",
        ],
    ),
    (
        10, 2, "sf_payette_staircase", "Staircase", "cfs", 800.0,
        2500.0, 4000.0, 5500.0, 44.09266, -116.04273,
        "https://www.americanwhitewater.org/content/River/view/river-detail/596/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=y2JDLtvURPs",
            "https://www.youtube.com/watch?v=EV293SIrfxA",
            "https://www.youtube.com/watch?v=9L0KsoEBN90",
            "https://www.youtube.com/watch?v=BCq61US91Mk",
            "https://www.youtube.com/watch?v=wZ6EQBSSHkI",
            "https://www.youtube.com/watch?v=lX9Q-32TT8s",
        ],
    ),
    (
        11, 5, "lower_deadwood", "Lower Deadwood", "cfs", 500.0,
        600.0, 800.0, 1000.0, 44.12035896843042, -115.65993042333568,
        "https://www.americanwhitewater.org/content/River/view/river-detail/3087/main",
        "Idaho",
        None,
        None,
    ),
    (
        12, 6, "salmon_to_riggins", "Bar To Riggins", "cfs", 2000.0,
        15000.0, 50000.0, 100000.0, 45.425417895205406, -116.15410279591201,
        "https://www.americanwhitewater.org/content/River/view/river-detail/1464/main",
        "Idaho",
        None,
        None,
    ),
    (
        13, 6, "salmon_from_riggins", "Riggins Day Stretch", "cfs", 2000.0,
        15000.0, 50000.0, 100000.0, 45.42561642509888, -116.31156968158616,
        "https://www.americanwhitewater.org/content/River/view/river-detail/613/main",
        "Idaho",
        None,
        None,
    ),
    (
        14, 6, "salmon_mill_wave", "Mill Wave", "cfs", 2500.0,
        3000.0, 3500.0, 4250.0, 45.413088303968834, -116.3156717788237,
        "https://www.americanwhitewater.org/content/River/view/river-detail/1464/main",
        "Idaho",
        None,
        None,
    ),
    (
        15, 7, "little_salmon", "Little Salmon", "cfs", 1800.0,
        2500.0, 3000.0, 3500.0, 45.18071615607979, -116.30109898821945,
        "https://www.americanwhitewater.org/content/River/view/river-detail/566/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=XyLBKL08GuY",
            "https://www.youtube.com/watch?v=3TDSAdJNf48",
            "https://www.youtube.com/watch?v=Sgvq-wdEIj4",
        ],
    ),
    (
        16, 8, "upper_lochsa", "Upper Lochsa", "cfs", 3000.0,
        5000.0, 10000.0, 16000.0, 46.45246084691649, -115.0790730835057,
        "https://www.americanwhitewater.org/content/River/view/river-detail/569/main",
        "Idaho",
        [
            "https://docs.google.com/spreadsheets/d/1mRQGuui8FOxZkd8GaWBucpU4-5n5Qlobp5tqRziM-lk/edit?gid=658837342#gid=658837342",
        ],
        [
            "https://www.youtube.com/watch?v=aninJaYapI0",
            "https://www.youtube.com/watch?v=MiyUxEMoM2s",
            "https://www.youtube.com/watch?v=W6FAd0te2qk",
            "https://www.youtube.com/watch?v=l9DKDqLYpvY",
        ],
    ),
    (
        17, 8, "lower_lochsa", "Lower Lochsa", "cfs", 3000.0,
        10000.0, 20000.0, 25000.0, 46.34450975906855, -115.30701702760331,
        "https://www.americanwhitewater.org/content/River/view/river-detail/570/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=rO_yGeSmIqc",
            "https://www.youtube.com/watch?v=Vw2WSLyZykE",
        ],
    ),
    (
        18, 9, "boise_ww_park", "Boise Whitewater Park", "cfs", 300.0,
        2000.0, 4000.0, 6000.0, 43.62549149357962, -116.2345402244785,
        "https://www.americanwhitewater.org/content/River/view/river-detail/3135/main",
        "Idaho",
        None,
        None,
    ),
    (
        19, 9, "boise_barber_park", "Barber Park Wave", "cfs", 4500.0,
        4800.0, 4900.0, 5000.0, 43.569944014591236, -116.14464778029726,
        "https://www.americanwhitewater.org/content/River/view/river-detail/3135/main",
        "Idaho",
        None,
        None,
    ),
    (
        20, 10, "owyhee_three_forks", "Three Forks to Rome", "cfs", 2000.0,
        3000.0, 5000.0, 15000.0, 42.544627063107505, -117.16881062503798,
        "https://www.americanwhitewater.org/content/River/view/river-detail/3764/main",
        "Oregon",
        None,
        None,
    ),
    (
        21, 11, "mf_salmon", "Middle Fork Salmon", "feet", 3.0,
        4.0, 5.0, 6.5, 44.396134040322906, -115.17008544598806,
        "https://www.americanwhitewater.org/content/River/view/river-detail/618/main",
        "Idaho",
        None,
        [
            "https://www.youtube.com/watch?v=eq8edaWxdAM",
            "https://www.youtube.com/watch?v=g6ccbtIQY3U",
            "https://www.youtube.com/watch?v=M9Mk-AYw2fI",
        ],
    ),
    (
        22, 12, "murtaugh", "The Murtaugh", "cfs", 1500.0,
        7000.0, 13500.0, 25000.0, 42.49959451272453, -114.15338370212318,
        "https://www.americanwhitewater.org/content/River/view/river-detail/631/main",
        "Idaho",
        [
            "https://www.whitewaterguidebook.com/idaho/snake-river-murtaugh/",
            "https://www.oregonkayaking.net/rivers/murtaugh/murtaugh.html",
        ],
        [
            "https://www.youtube.com/watch?v=pNkSCPHRA9k",
            "https://www.youtube.com/watch?v=24O2zdH3bxQ",
            "https://www.youtube.com/watch?v=dwFAPIqpDSg",
            "https://www.youtube.com/watch?v=Wa2HcFFjXyI",
        ],
    ),
    (
        23, 2, "sf_payette_swirly", "Swirly Canyon", "cfs", 300.0,
        1500.0, 4000.0, 6500.0, 44.0620496750458, -115.81296355443007,
        "https://www.americanwhitewater.org/content/River/view/river-detail/4121/main",
        "Idaho",
        None,
        None,
    ),
    (
        24, 14, "bruneau_jarbidge", "Bruneau Jarbidge", "cfs", 700.0,
        1000.0, 2000.0, 2500.0, 42.33799118494392, -115.64698219299316,
        "https://www.americanwhitewater.org/content/River/view/river-detail/533/main",
        "Idaho",
        None,
        None,
    ),
    (
        25, 4, "nf_payette_cabarton", "The Cabarton", "cfs", 1000.0,
        2000.0, 4000.0, 7000.0, 44.41358187316328, -116.03201866149902,
        "https://www.americanwhitewater.org/content/River/view/river-detail/591/main",
        "Idaho",
        None,
        None,
    ),
    (
        26, 3, "mf_payette_nozzle", "The Nozzle", "cfs", 500.0,
        1000.0, 2000.0, 2500.0, 44.23820460024976, -115.89900255203247,
        "https://www.americanwhitewater.org/content/River/view/river-detail/4120/main",
        "Idaho",
        None,
        None,
    ),
    (
        27, 4, "nf_payette_kellys", "Kelly's Whitewater Park", "cfs", 600.0,
        1800.0, 4000.0, 8000.0, 44.511460812576104, -116.0314784831979,
        "https://www.americanwhitewater.org/content/River/view/river-detail/11051/main",
        "Idaho",
        None,
        None,
    ),
]

# Signed gauge numbers: (2, -3, -6) reads gauge 2 minus gauge 3 minus gauge 6.
STANDARD_FORMULAS = {
    1: (2,), 2: (2,), 3: (2,), 4: (2,), 5: (3,), 6: (4,), 7: (4,), 8: (4, 5), 9: (15,),
    10: (2, -3), 11: (5,), 12: (8,), 13: (8,), 14: (8,), 15: (9,), 16: (1,), 17: (1,), 18: (7,),
    19: (7,), 20: (12,), 21: (10,), 22: (11,), 23: (4, 5), 24: (14,), 25: (13,), 26: (6,), 27: (13,),
}
MAX_FORMULAS = {8: (2, -3, -6), 23: (2, -3, -6), 25: (3,)}

METRIC_OF_UNIT = {"cfs": "flow_cfs", "feet": "stage_ft"}

# End of fixed values.


class Series(NamedTuple):
    """One derived level series: a signed sum of gauges for a section and flow type."""

    section_id: int
    flow_type: str
    terms: tuple[int, ...]

    @property
    def column(self) -> str:
        suffix = "_max" if self.flow_type == "max" else ""
        return f"section_id_{self.section_id}{suffix}"


SERIES = sorted(
    [Series(sid, "standard", terms) for sid, terms in STANDARD_FORMULAS.items()]
    + [Series(sid, "max", terms) for sid, terms in MAX_FORMULAS.items()],
    key=lambda s: (s.section_id, s.flow_type != "standard"),
)

GAUGE_IDS = tuple(row[0] for row in GAUGE_ROWS)
GAUGE_NAMES = {row[0]: row[1] for row in GAUGE_ROWS}
UNIT_OF_SECTION = {row[0]: row[4] for row in SECTION_ROWS}

COEFFICIENT_ROWS = [
    (s.section_id, s.flow_type, abs(term), 1.0 if term > 0 else -1.0) for s in SERIES for term in s.terms
]


def _local(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    columns = list(zip(*rows))
    arrow = pa.table(
        {f.name: pa.array(columns[i], type=schemas.arrow_type(f.dataType)) for i, f in enumerate(schema.fields)}
    )
    return spark.createDataFrame(arrow, schema)


def rivers(spark: SparkSession) -> DataFrame:
    return _local(spark, RIVER_ROWS, schemas.RIVERS)


def gauges(spark: SparkSession) -> DataFrame:
    return _local(spark, GAUGE_ROWS, schemas.GAUGES)


def sections(spark: SparkSession) -> DataFrame:
    return _local(spark, SECTION_ROWS, schemas.SECTIONS)


def coefficients(spark: SparkSession) -> DataFrame:
    return _local(spark, COEFFICIENT_ROWS, schemas.COEFFICIENTS)
