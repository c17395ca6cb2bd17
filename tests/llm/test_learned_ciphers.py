"""Ciphers that no starting code page holds are learnt per source; what can't be learnt isn't listed."""

from __future__ import annotations

import random

from caseloom.llm import encodings

GREEK = (
    "ο μάρτυρας δήλωσε ότι το έγγραφο ήταν στο γραφείο και η πληρωμή έγινε χωρίς απόδειξη από την εταιρεία πριν από το τέλος του μήνα ενώ ο ελεγκτής ζήτησε αντίγραφα των λογαριασμών "
    "για κάθε παραλαβή που υπέγραψε ο διευθυντής με την τράπεζα όμως κανείς δεν βρήκε τις σφραγίδες ούτε τα βιβλία της αποθήκης όπως είχε ψευδώς γραφτεί αργότερα στην ίδια έκθεση"
).split()
TURKISH = (
    "tanık şirketin ödemeyi gecikmiş olarak yaptığını ve faturanın imzasız kaldığını söyledi müdür ise belgelerin çalındığını bildirdi çünkü depodaki sayım yanlıştı eğer banka yazıyı görseydi "
    "açıkça başka bir karar çıkardı bu yüzden başvuru reddedildi ışık altında yapılan inceleme kağıtların değiştiğini gösterdi ağır suçlama şimdilik askıya alındı"
).split()
SPANISH = "según el señor de la oficina la dirección número uno fue añadida después por la compañía también está aquí".split()


def text(words, rng, n=30):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def corpus(spark, rng, sound_languages, garbled):
    rows = []
    for k in range(240):
        rows.append((len(rows), f"S{k % 6}_{k}.txt", text(sound_languages[k % len(sound_languages)], rng), None))
    for k in range(60):
        truth = text(garbled[0], rng)
        rows.append((len(rows), f"BAD_{k}.txt", garbled[1](truth), truth))
    df = spark.createDataFrame([r[:3] for r in rows], "extraction_id long, file_name string, text string")
    return df, {r[0]: r[3] for r in rows if r[3]}


def letters_right(got, want):
    pairs = [(a, b) for a, b in zip(got, want) if b > "\x7f"]
    return sum(a == b for a, b in pairs) / len(pairs)


def permutation():
    """A cipher of no code page: the letters of Greek dealt to the upper signs of latin-1 at random."""
    rng = random.Random(3)
    letters = sorted({c for w in GREEK for c in w})
    signs = rng.sample([chr(k) for k in range(0xC0, 0x100) if chr(k) not in "×÷"], len(letters))
    return str.maketrans(dict(zip(letters, signs)))


def test_held_out_pages_are_learnt(spark):
    made_up = permutation()
    for words, garble in ((GREEK, lambda t: t.encode("cp1253").decode("cp1252", "replace")), (TURKISH, lambda t: t.encode("cp1254").decode("cp1252")), (GREEK, lambda t: t.translate(made_up))):
        df, truth = corpus(spark, random.Random(11), [GREEK, TURKISH, SPANISH], (words, garble))
        got = {r["extraction_id"]: r for r in encodings.restored(df).collect()}
        assert set(got) <= set(truth)  # precision: no sound text is listed
        assert len(got) >= 0.95 * len(truth)
        right = [letters_right(got[k]["text"], truth[k]) for k in got]
        assert sum(right) / len(right) >= 0.9


def test_a_language_nobody_else_has_is_left_alone(spark):
    """Without Greek elsewhere neither sound nor garbled Greek of one source can be told: it isn't listed, and not restored to something wrong."""
    for garble in (lambda t: t, lambda t: t.translate(permutation())):
        df, truth = corpus(spark, random.Random(5), [TURKISH, SPANISH], (GREEK, garble))
        assert encodings.restored(df).filter("state = 'restorable'").count() == 0
