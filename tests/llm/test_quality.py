from corpusloom.llm import quality

PROSE = "The archive at Leithall holds 883 letters about the tax, and the winding ones were studied in 1539. It was closed for the first time. " * 3
CASES = {
    1: (PROSE, "prose"),
    2: ("Index of names\n" + "\n".join(f"{k}) {a} lock" for k, a in enumerate("damp minor tidal copper early rare ornate gilded pale late".split())), "list"),
    3: ("Fakous 189; Wumeas 125; Lothan 199; Stock 308; Brougaeck 345; Greil 363", "list"),
    4: ('"1757";"prison";"70.57"\n"Dratheas";"1917";"1875"\n"1812";"Reasaesk";"67.18"', "table"),
    5: ("1798            20.25           5.30\nPeadum          1650            island\nkiln            14.05           x", "table"),
    6: ("KgntlHyWpCUwhqkeRq5c6RIYDcskNVz2HOM7ScLIQGzdw3IvCkwKyPLZbLMzl9nJZqWJPtpjxo5Rg8hXyZjEunCVm", "junk"),
    7: ("barracks inn furnace wall petition medal 85581 Dreind !!!!\n" * 8, "junk"),
    8: ("xcvjk qwrtz sdfgh hjklm zxcvnm dfghj " * 8, "junk"),
    9: ("<p>" + PROSE + "</p>", "prose"),
    10: ("", "junk"),
    11: (None, "junk"),
    12: ("Im Jahr 1692 wurde der Fluss vermessen, und die Leute waren damit nicht zufrieden. " * 4, "prose"),
    13: (PROSE * 4000, "prose"),
    14: ("  \n\n \t ", "junk"),
}


def test_kinds_and_reasons(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in CASES.items()] + [(None, "x", "x")], "index bigint, text string, key string")
    rows = {r["index"]: r for r in quality.kinds(quality.statistics(df)).collect()}
    assert {k: r["kind"] for k, r in rows.items()} == {k: kind for k, (_, kind) in CASES.items()}
    assert rows[1]["reasons"] == [] and "few words" in rows[10]["reasons"] and "many words" in rows[13]["reasons"] and "repeated lines" in rows[7]["reasons"]
    assert rows[1]["words"] == 75 and rows[1]["lines"] == 1 and rows[11]["chars"] == 0
    assert quality.kinds(quality.statistics(df.limit(0))).count() == 0
    assert quality.statistics(df.union(df)).count() == 2 * len(CASES)
