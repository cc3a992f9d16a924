"""A hand-written book of two chapters that holds every kind of block once; the tables given have no figures, footnotes or
drawn boxes to convert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumspark.model import LINE
from vellumspark.operators.stream import ITEM

# page, y0, size, bold, x0, x1, raw, box
C1 = [
    (1, 60.0, 16.0, True, 50.0, 200.0, "Cell", None), (1, 78.0, 16.0, True, 50.0, 200.0, "Walls", None),
    (1, 110.0, 10.0, False, 50.0, 300.0, "The wall of a plant cell is made of cellu-", None), (1, 122.0, 10.0, False, 50.0, 300.0, "lose, takes 5 mg and gives a firm shape† in well-", None),
    (1, 134.0, 10.0, False, 50.0, 150.0, "known cases of growth.", None),
    (1, 160.0, 12.0, True, 50.0, 120.0, "Layers", None),
    (1, 180.0, 10.0, False, 60.0, 200.0, "• primary wall", None), (1, 192.0, 10.0, False, 75.0, 200.0, "– middle layer", None), (1, 204.0, 10.0, False, 60.0, 200.0, "• cellulose", None),
    (1, 230.0, 9.0, False, 50.0, 200.0, "Figure 1.1. A wall", None),
    (1, 330.0, 10.0, False, 50.0, 150.0, "E = m × v", None),
    (1, 360.0, 10.0, False, 50.0, 300.0, "The the text goes on as Figure 1.2 shows with an odd-", None), (1, 372.0, 10.0, False, 50.0, 140.0, "bod in it.", None),
    (1, 700.0, 8.0, False, 50.0, 200.0, "† Measured dry.", None), (1, 720.0, 8.0, False, 50.0, 200.0, "‡ Nowhere marked.", None),
    (2, 60.0, 10.0, True, 50.0, 120.0, "Key points", 1), (2, 74.0, 10.0, False, 50.0, 300.0, "Walls are firm.", 1),
    (2, 110.0, 9.0, False, 50.0, 200.0, "Table 1.1: Doses", None),
    (2, 190.0, 10.0, True, 50.0, 120.0, "WARNING", None), (2, 215.0, 10.0, False, 50.0, 300.0, "Keep them dry [1,3].", None),
    (2, 240.0, 12.0, True, 50.0, 120.0, "References", None),
    (2, 260.0, 10.0, False, 50.0, 300.0, "1. Author A. On walls and", None), (2, 272.0, 10.0, False, 50.0, 300.0, "their layers, at https://walls.test/a.", None), (2, 290.0, 10.0, False, 50.0, 300.0, "2. Author B. On cells.", None),
]
C2 = [(3, 60.0, 16.0, True, 50.0, 200.0, "Another Title", None), (3, 100.0, 10.0, False, 50.0, 300.0, "Some text of the second chapter, which ends here.", None)]


def lines(spark: SparkSession) -> DataFrame:
    rows = [("b", key, *r) for key, part in (("c1", C1), ("c2", C2)) for r in part]
    out = [(i, b, key, page, i, x0, y0, x1, y0 + size, size, bold, False, raw, None, box, 0.5 if raw == "bod in it." else 0.95) for i, (b, key, page, y0, size, bold, x0, x1, raw, box) in enumerate(rows)]
    return spark.createDataFrame(out, LINE)


def chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("b", "c1", 1, "Cell Walls", 1, 2), ("b", "c2", 2, "Organs of Plants", 3, 4)], "book_id string, chapter_key string, chapter_no int, title string, page_from int, page_to int")


def items(spark: SparkSession) -> DataFrame:
    table = "| Drug | Dose |\n| --- | --- |\n| A | 12 mg |"
    rows = [
        ("b", "c1", 1, "figure", 1, 50.0, 245.0, 250.0, 310.0, "figure_c1_01.png", ["lumen"], None, None, 0.9, None, None, None, None, None, None, None, None),
        ("b", "c1", 2, "table", 2, 50.0, 125.0, 250.0, 170.0, None, None, table, "Drug Dose A 12 mg", 0.62, 2, 2, 4, 0, 0, True, False, ["12", "15"]),
        ("b", "c2", 3, "scanned", 4, 0.0, 0.0, 600.0, 800.0, "figure_c2_01.png", None, None, None, 0.0, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, ITEM)
