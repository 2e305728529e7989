import pytest

from lodestat.operators.units import Unit, UnitGrammar, convert_quantities, read_number

CATALOGUE = [
    ("1", None, "KGM", "kg", 0), ("2", "1", "GRM", "g", -3), ("3", "1", "TNE", "t", 3), ("4", "3", "KTNE", "kt", 3), ("5", None, "PCT", "%", 0), ("6", "5", "BPS", "pb", -2), ("7", "5", "PMIL", "‰", -1),
    ("8", None, "QLM", "Q$", 0), ("9", "8", "K_QLM", "kQ$", 3), ("10", "9", "M_QLM", "MMQ$", 3), ("11", "10", "G_QLM", None, 3), ("12", None, "TNS", "T/", 0), ("13", None, "KWH", "kWh", 0), ("14", "13", "MWH", "MWh", 3),
    ("15", None, "LTR", "l", 0), ("16", "15", "MTQ", "m³", 3), ("17", "15", "HLT", "hl", 2), ("18", "8", "CENT_QLM", "c", -2), ("19", "19", "LOOP", None, 1), ("20", "99", "DANGLING", None, 1), ("21", None, "ARV", "Av", 0),
    ("22", "3", "K_TNE", None, 3, "Miles de toneladas"), ("23", "8", "MM_QLM", None, 6, "Millones de quilmares"), ("24", "15", "MLT", "ml", -3), ("25", "13", "WHR", "Wh", -3),
]
G = UnitGrammar(CATALOGUE)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3,8", 3.8), ("9.999", 9999), ("0.944", 0.944), ("1,331,255", 1331255), ("26.627,50", 26627.5), ("9,999.9", 9999.9), ("−12.640,59", -12640.59), ("+5", 5), ("", None), ("x", None), (None, None), ("1e5", None)],
)
def test_numbers(raw, want):
    got = read_number(raw)
    assert (None if got is None else got[0] / 10 ** got[1]) == want


CASES = [
    ("3,50", ["%"], None, "Tasa activa: 3,50", "es", ("PCT", 3500)), ("3", None, "4", None, "es", ("KGM", 3 * 10**9)), ("3", [], "11", "Gasto: 3", "es", ("QLM", 3 * 10**12)), ("13", [], "7", "X | 13", "es", ("PCT", 1300)),
    ("70", ["ARV", "MILLION"], None, "Loan book = 70", "en", ("ARV", 70 * 10**9)), ("2", ["THOUSAND", "kg"], None, None, "es", ("KGM", 2 * 10**6)), ("3.746,24", ["TNS"], None, "varió a T/ 3.746,24 MM y 72,6 mil empleos", "es", ("TNS", 3746240000 * 1000)),
    ("12,9", [], None, "sumó 12,9 billones de quilmares, dijo", "es", ("QLM", 12900000000000 * 1000)), ("1.76", [], None, "puts it at Q$1.76 bn; the rate was Q$5.7.", "en", ("QLM", 1760000000 * 1000)), ("3", [], None, "came to 3 trillion quilmars", "en", ("QLM", 3 * 10**15)),
    ("17", [], None, "sumó 17 mil millones de QLM", "es", ("QLM", 17 * 10**12)), ("26,627", [], None, "Table 325 (millions of quilmars). Revenue: 26,627", "en", ("QLM", 26627 * 10**9)), ("5167", None, None, "Volume in tonnes. Fish landings: 5167", "en", ("KGM", 5167 * 10**6)),
    ("1", [], None, "Volumen (t) - Cosecha 1", "es", ("KGM", 10**6)), ("8", [], None, "Con 73,1 millones de personas censadas, varió a 8 hectolitros", "es", ("LTR", 800000)), ("5", [], None, "Hubo 5 reuniones en Rianguife.", "es", (None, None)),
    ("9", [], None, "Cuadro 9 (en miles de quilmares) describe 8 litros", "es", (None, None)), ("2", [], None, "sumó 2 puntos básicos", "es", ("PCT", 20)), ("4", [], None, "En 61,9 GWh y 13 días: llegó a 4 litros", "es", ("LTR", 4000)), ("7", ["", None], None, "", "es", (None, None)),
    ("5", [], None, "sumó 5 miles de gramos", "es", ("KGM", 5000)), ("2", [], None, "sumó 2 mil gramos", "es", ("KGM", 2000)), ("7", [], None, "sumó 7 miles de mililitros", "es", ("LTR", 7000)), ("3", ["THOUSAND"], "2", None, "es", ("KGM", 3000)),
    ("3", ["MILLION"], "2", "X: 3", "es", ("KGM", 3 * 10**6)), ("3", ["THOUSAND"], "3", None, "es", ("KGM", 3 * 10**9)), ("2", ["MILLION"], "14", "sumó 2 millones de MWh", "es", ("KWH", 2 * 10**12)), ("4", [], "14", "sumó 4 mil kWh", "es", ("KWH", 4 * 10**6)),
    ("3", ["THOUSAND"], "22", "sumó 3", "es", ("KGM", 3 * 10**9)), ("3", ["qlm"], "23", "sumó 3 millones de quilmares", "es", ("QLM", 3 * 10**9)), ("3", [], "23", None, "es", ("QLM", 3 * 10**9)), ("4", [], None, "sumó 4 miligramos", "es", ("KGM", 0)),
    ("4000", [], None, "sumó 4000 mg", "es", ("KGM", 4)), ("6", [], None, "reached 6 centilitres", "en", ("LTR", 60)), ("1", [], None, "reached 1 megatonne", "en", ("KGM", 10**12)), ("8", [], None, "sumó 18 kg, no 8 litros; 8 kg", "es", ("LTR", 8000)),
    ("1,5", [], None, "at QLM 1,5 mn", "en", ("QLM", 1500000000)), ("3,5", ["MILLION", "qlm"], None, "sumó 3,5 millones de QLM", "es", ("QLM", 3500000000)), ("6", [], None, "sumó 6 quilmares por tonelada", "es", (None, None)), ("1", [], None, "en 2011: 1 kg", "es", ("KGM", 1000)),
]


@pytest.mark.parametrize("case", CASES)
def test_grammar(case):
    assert G.convert(*case[:5]) == case[5]


def test_unit_algebra():
    kg, l = Unit((("KGM", 1),), 3), Unit((("LTR", 1),), 2)
    assert kg.times(l, -1) == Unit((("KGM", 1), ("LTR", -1)), 1) and kg.times(l, -1).base() is None
    assert kg.times(l, -1).times(l).base() == "KGM" and "LOOP" not in G.units and "DANGLING" not in G.units


def test_table(spark):
    units = spark.createDataFrame([(*c, "x")[:6] for c in CATALOGUE], "unit_measure_id string, base_unit_measure_id string, code string, symbol string, multiplier_power10 int, name string")
    schema = "occurrence_id long, raw string, units array<string>, unit_measure_id string, context_text string, lang string, base_milli string"
    rows = [(1, "3", None, "2", None, None, "x"), (1, "3", None, "2", None, None, "x"), (2, None, None, "2", None, "es", None), (None, "3", None, "2", None, "es", None), (3, "7", ["kg"], None, "w " * 60_000 + "7", "es", None)]
    assert {tuple(r) for r in convert_quantities(spark.createDataFrame(rows, schema), units).collect()} == {(1, "KGM", 3), (3, "KGM", 7000)}
    assert convert_quantities(spark.createDataFrame([], schema), units).count() == 0
