import hashlib
from collections import Counter

import pytest

from lodestat.llm.encoding import Cipher, bigram_model, learn_ciphers, lost, page_table, restore_text, restore_texts, restored_digest, stage

CLEAN = "La producción de café en Ñuñoa subió, según el boletín del miércoles: “más de lo previsto” — dijo José. A inflação não caiu em março."


QUESTIONS = ["Prices fell. Really? Yes.", "El precio sube, verdad? Si", "Sure? no", "Subiu mesmo? Sim.", "Is it?"]
SOUND = ["Está en Bogotá, según José; subió más que en Perú. El café también, verdad que así será.", "O café subiu em março e não caiu; será que você virá?", "Prices fell and that is sure. The rest of the year is fine."] * 40
MODEL = bigram_model(Counter((a, b) for t in SOUND for a, b in zip((" " + t.lower() + " "), (t.lower() + " "))), lost_marks=40, asked=40)


def read_as(text, written, read):
    data = text.encode(written)
    return "".join(bytes([b]).decode(read, errors="ignore") or chr(b) for b in data) if read == "cp1252" else data.decode(read)


@pytest.mark.parametrize(
    ("damaged", "kind"),
    [
        (read_as(CLEAN, "utf-8", "cp1252"), "utf8"), (CLEAN.encode().decode("latin-1"), "utf8"), (read_as(read_as(CLEAN, "utf-8", "cp1252"), "utf-8", "cp1252"), "utf8"),
        (CLEAN + " " + read_as(CLEAN, "utf-8", "cp1252"), "utf8"), (read_as("﻿" + CLEAN, "utf-8", "cp1252"), "utf8"),
        (CLEAN.encode("utf-16-be").decode("utf-16-le"), "wide"), ("ÿþ" + CLEAN.replace("“", '"').replace("”", '"').replace("—", "-").encode("utf-16-le").decode("latin-1"), "wide"),
    ],
)
def test_swaps_of_wide_units(damaged, kind):
    want = CLEAN + " " + CLEAN if damaged.startswith(CLEAN) else CLEAN
    if damaged.startswith("ÿþ"):
        want = CLEAN.replace("“", '"').replace("”", '"').replace("—", "-")
    assert restore_text(damaged) == (kind, want)


def test_utf8_read_as_utf16():
    even = CLEAN if len(CLEAN.encode()) % 2 == 0 else CLEAN + "."
    assert restore_text(even.encode().decode("utf-16-le")) == ("wide", even)


@pytest.mark.parametrize("text", [None, "", CLEAN, "SÃO JOSÉ e o comitê da ÂNCORA", "12 ¢, § 4 ¶ y 3 ½ €", "¿Qué pasó? ¡Atención!", "nota?id=48&v=2.", "农业产量略有下降。运输成本仍然很高。", "What happened? Nobody knows."])
def test_sound_texts(text):
    assert restore_text(text, MODEL) is None


@pytest.mark.parametrize("text", ["evit� record�", "m?s producci?n", "?Qu? pas?? ?Atenci?n!", "Compa?ia en Tamguimqu? Ltda."])
def test_lost(text):
    assert restore_text(text, MODEL) == ("lost", "") and lost(text)


def test_cipher_is_learned_from_the_corpus(spark):
    words = "la inflación subió según el boletín más café año señaló después José índice público región también economía número país fútbol niño mañana aquí acción".split()
    clean = [" ".join(words[(i * 7 + j * 3) % len(words)] for j in range(25)) for i in range(120)]
    bad = [(1000 + i, f"s{i % 3}", clean[i].encode("cp850").decode("cp1252", errors="replace").replace("�", "\x81")) for i in range(8)]
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(clean)] + bad + [(2000, "s", None), (2001, "s", ""), (1000, "s0", bad[0][2]), (None, "s", "x")]
    df = spark.createDataFrame(rows, "response_id long, source_code string, text string")
    assert learn_ciphers(stage(df.where("text IS NOT NULL").select("source_code", "text", "response_id")))[1].pairs[0] == ("cp1252", "cp850")
    got = {r["response_id"]: r["restored_md5"] for r in restored_digest(restore_texts(df)).collect()}
    assert got == {1000 + i: hashlib.md5(clean[i].encode()).hexdigest() for i in range(8)}


@pytest.mark.parametrize("text", QUESTIONS)
def test_sound_questions(text):
    assert restore_text(text, MODEL) is None


@pytest.mark.parametrize("text", ["Vive en Bogot? desde 2010", "segun lo que est? en vigor", "el caf?, el pan"])
def test_lost_at_the_end_of_a_word(text):
    assert not lost(text) and restore_text(text, MODEL) == ("lost", "")


def test_swaps_of_two_sources_and_one_outside_the_pages(spark):
    words = "la inflación subió según el boletín más café año señaló después José índice público región también economía número país fútbol niño mañana aquí acción".split()
    clean = [" ".join(words[(i * 7 + j * 3) % len(words)] for j in range(25)) for i in range(200)]
    swaps = {"a": ("cp850", "cp1252"), "b": ("mac_roman", "cp1252"), "c": ("cp1252", "cp437")}
    bad = [(1000 + 20 * k + i, s, read_as(clean[i], *swap)) for k, (s, swap) in enumerate(swaps.items()) for i in range(20)]
    odd = str.maketrans("áéíóúñ", "¤¥¦§¨©")
    bad += [(2000 + i, "d", clean[i].translate(odd)) for i in range(20)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(clean)] + [(3000 + i, "q", t) for i, t in enumerate(QUESTIONS)] + bad, "response_id long, source_code string, text string")
    got = {r["response_id"]: r["restored"] for r in restore_texts(df).collect()}
    assert got == {i: clean[i % 1000 % 20] for i, _, _ in bad}


def test_two_pages_in_one_corpus(spark):
    words = "la inflación subió según el boletín más café año señaló después José índice público región también economía número país fútbol niño mañana aquí acción".split()
    clean = [" ".join(words[(i * 7 + j * 3) % len(words)] for j in range(25)) for i in range(120)]
    bad = [(1000 + i, f"s{i >= 8}", read_as(clean[i], "cp850" if i < 8 else "mac_roman", "cp1252")) for i in range(11)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(clean)] + bad, "response_id long, source_code string, text string")
    got = {r["response_id"]: r["restored"] for r in restore_texts(df).collect()}
    assert got == {1000 + i: clean[i] for i in range(11)}


def test_empty_table_and_tables(spark):
    df = spark.createDataFrame([], "response_id long, source_code string, text string")
    assert restore_texts(df).count() == 0
    assert page_table("cp850")[ord("‚")] == "é" and isinstance(bigram_model(Counter()).score("é"), float)
