import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import entities, surrogates
from tracelake.llm.pii import KEY_SETTING, personal_information, redacted, session_key, surrogate_table

CASES = {
    "Signed off by zelma belinger, badge desk informed.": {("person", "zelma belinger")},
    "Witness: Pellault, Sunniva; ID no. ZZ5378749 A relay": {("person", "Pellault, Sunniva"), ("id_number", "ZZ5378749")},
    "Mr. A. Calrada and Ms. BRISA BRIMDERY-OST watched the cold soak.": {("person", "A. Calrada"), ("person", "BRISA BRIMDERY-OST")},
    "判定: PARTIAL担当者: Keldan K. Thornholt。温度は59℃": {("person", "Keldan K. Thornholt")},
    "連絡先はyara_nar AT mail DOT example DOT netです": {("email", "yara_nar AT mail DOT example DOT net")},
    "cc: shift-a@example.com; b.c+rig4[at]qa.rig.example, mailto:x'y@soak.invalid?subject=s": {("email", "shift-a@example.com"), ("email", "b.c+rig4[at]qa.rig.example"), ("email", "x'y@soak.invalid")},
    "Phone: (415) 555-0121, ext. 25": {("phone", "(415) 555-0121")},
    "My mobile is 01.99.00.59.16 if, or 030 / 23125-540, 0044 1632 960203.": {("phone", "01.99.00.59.16"), ("phone", "030 / 23125-540"), ("phone", "0044 1632 960203")},
    "Call Ruddery, Ilka on +49 30 23125 958 before": {("person", "Ruddery, Ilka"), ("phone", "+49 30 23125 958")},
    "employee: B. Rud | id: QQ 30 44 91 A | tel: 512.555.0127": {("person", "B. Rud"), ("id_number", "QQ 30 44 91 A"), ("phone", "512.555.0127")},
    "Passport no. 000-98-7314 was copied for the site pass of Daven Calsworth.": {("id_number", "000-98-7314"), ("person", "Daven Calsworth")},
    "load cell to 33 Velmere St.. Home address given as 36-38 Tannery Drive, Apt 72, Calder Vale 99435, phone": {("address", "33 Velmere St."), ("address", "36-38 Tannery Drive, Apt 72, Calder Vale 99435")},
    "Lieferung an Hüttenallee 46, 99515 Fallmouth Quay. Livraison à 47 rue des Tanneurs Gris, 99967 Tressby.": {("address", "Hüttenallee 46, 99515 Fallmouth Quay"), ("address", "47 rue des Tanneurs Gris, 99967 Tressby")},
    "-- \nQuill Pellinger\nCalle del Horno Viejo 185, 99531 Lowmere\n01632 960 073 Door": {("person", "Quill Pellinger"), ("address", "Calle del Horno Viejo 185, 99531 Lowmere"), ("phone", "01632 960 073")},
    "collected from FLAT": set(),
    "Order 207-11-7787, Part number ZC 44 81 71 C, S/N 412-55-0918, Part 30.23125.67, Checksum 038-2055-0138, Log window 1699006201600 to 1699006201690": set(),
    "rev 1.8.85@build8, Setpoint held @ 25 C, 192.0.2.3, Kestrel Probe and Falcon Rig, Line 4 Avenue Loop: 19 counts, Bay 2 Lane 7 was blocked": set(),
}


def test_unlabelled_numbers_of_any_range():
    for number in ("123-45-6789", "123 45 6789", "987-65-4321", "666-12-3456"):
        assert [(e.kind, e.text) for e in entities.find(f"Badge given to {number}, then closed.")] == [("id_number", number)]
    for decoy in ("S/N 123-45-6789", "S/N: 123-45-6789", "Order# 123-45-6789", "PASSOrder 207-11-7787", "Lot\n123-45-6789", "Batch 123-45-6789", "1123-45-6789", "123-45-6789-1", "123-45 6789"):
        assert entities.find(decoy) == [], decoy


def test_cases_and_decoys():
    for text, want in CASES.items():
        assert {(e.kind, e.text) for e in entities.find(text)} == want, text
    assert entities.find(None) == entities.find("") == entities.find(" \n") == []
    long = "noise 12 " * 50_000 + "Ask Lioba Falault about it " + "@" * 2000 + "0" * 5000
    assert [(e.kind, e.text) for e in entities.find(long)] == [("person", "Lioba Falault")]


def test_surrogates_keep_format_and_agree():
    say = lambda kind, text: surrogates.render(kind, text, [surrogates.replace_atom(kind, a) for a in surrogates.atoms(kind, text)])
    shape = lambda t: re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[a-zà-þ]", "a", re.sub(r"\d", "9", t)))
    for text, found in CASES.items():
        for kind, value in found:
            new = say(kind, value)
            assert new != value and shape(new) == shape(value), (value, new)
    a, b, c = say("person", "Petra Ostberg"), say("person", "OSTBERG, PETRA"), say("person", "P. Ostberg")
    assert b == f"{a.split()[1].upper()}, {a.split()[0].upper()}" and c == f"{a[0]}. {a.split()[1]}"
    assert say("phone", "0044 1632 960203")[4:].replace(" ", "")[-8:] == say("phone", "+44 1632 960203").replace(" ", "")[-8:]


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(100, None, "x"), (101, "", "x"), (102, "  ", "x"), (0, list(CASES)[0], "x"), (None, list(CASES)[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = {(r.doc_id, r.pii_kind, r.pii_text) for r in personal_information(df).collect()}
    assert got == {(i, k, v) for i, found in enumerate(CASES.values()) for k, v in found} | {(None, "person", "zelma belinger")}
    for style in ("placeholder", "surrogate"):
        out = redacted(df, style).collect()
        assert len(out) == len(rows)
        texts = {r.doc_id: r.text for r in out}
        assert texts[100] is None and texts[101] == "" and texts[102] == "  "
        for i, (text, found) in enumerate(CASES.items()):
            assert (texts[i] == text) == (not found) and not any(v in texts[i] for _, v in found)
        # everything between the entities is unchanged
        first = texts[0]
        assert first.startswith("Signed off by ") and first.endswith(", badge desk informed.")
    assert redacted(df.limit(0)).count() == 0 == personal_information(df.limit(0)).count()


def test_surrogates_do_not_collide(spark):
    words = [a + b for a in "bcdf" for b in "aeiou"] + [f"{k:05d}" for k in range(300)]
    found = spark.createDataFrame([("person", [w]) for w in words[:20]] + [("id_number", [w]) for w in words[20:]], "pii_kind string, atoms array<string>")
    table = surrogate_table(found).collect()
    assert len(table) == 320 and len({(r.pii_kind, r.surrogate) for r in table}) == 320


#: Sentences whose cues are none of the pattern's own test texts above: (text, entities).
UNSEEN = [
    ("Please email John Smith about the gasket.", {("person", "John Smith")}),
    ("My name is Peter Brown.", {("person", "Peter Brown")}),
    ("All good.\nRegards,\nJohn Smith", {("person", "John Smith")}),
    ("Kind regards,\n\nMarta L. Kowalska\nLab 4", {("person", "Marta L. Kowalska")}),
    ("担当者:田中太郎", {("person", "田中太郎")}),
    ("负责人:李明。", {("person", "李明")}),
    ("Reach me on 020 7946 0958 today", {("phone", "020 7946 0958")}),
    ("office 0161 496 0123.", {("phone", "0161 496 0123")}),
    ("Dear Mary Jones, the chamber is free.", {("person", "Mary Jones")}),
    ("Thanks, Olga P. Ivanova", {("person", "Olga P. Ivanova")}),
    ("relay repaired by J. O'Neil-Smith yesterday", {("person", "J. O'Neil-Smith")}),
    ("Supervisor: Anna Groß-Weber", {("person", "Anna Groß-Weber")}),
    ("mit freundlichen Grüßen\nAnna Weber", {("person", "Anna Weber")}),
    ("Je m'appelle Claire Dubois.", {("person", "Claire Dubois")}),
    ("Me llamo Carmen Ortega Ruiz", {("person", "Carmen Ortega Ruiz")}),
    ("Ask M. Quenholt about the probe.", {("person", "M. Quenholt")}),
    ("The auditor Lena Vogt was late", {("person", "Lena Vogt")}),
    ("yesterday Lena Vogt came by", {("person", "Lena Vogt")}),
    ("ship to 206 TANNERY CLOSE, BRENNFURT.", {("address", "206 TANNERY CLOSE, BRENNFURT")}),
    ("lives at 12 Rue Lepic, 75018 Paris", {("address", "12 Rue Lepic, 75018 Paris")}),
    ("wohnt Lindenstraße 5, 10969 Berlin", {("address", "Lindenstraße 5, 10969 Berlin")}),
    ("mail " + "x" * 230 + "@mail.example.com please", {("email", "x" * 230 + "@mail.example.com")}),
    ("write anna(at)host(dot)example", {("email", "anna(at)host(dot)example")}),
    ("her SSN is 123-45-6789", {("id_number", "123-45-6789")}),
    ("NINO QQ123456C was noted", {("id_number", "QQ123456C")}),
]


def test_recall_on_unseen_cues():
    """Recall by kind, as the README reports it: at least 0.9 over all, nothing found that is none."""
    hit, all_ = {}, {}
    for text, want in UNSEEN:
        got = {(e.kind, e.text) for e in entities.find(text)}
        assert got <= want, (text, got)
        for case in want:
            all_[case[0]] = all_.get(case[0], 0) + 1
            hit[case[0]] = hit.get(case[0], 0) + (case in got)
    print({k: f"{hit[k]} of {n}" for k, n in all_.items()})
    assert sum(hit.values()) >= 0.9 * sum(all_.values())


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(entities.KINDS), st.text(min_size=1, max_size=12), st.sampled_from(["", "f", "m", "?"]))
def test_any_atom_of_any_script_changes(kind, text, told):
    for atom, gender in zip(surrogates.atoms(kind, text), surrogates.genders(kind, text, told)):
        if not any(c.isalnum() for c in atom):
            continue
        new = surrogates.replace_atom(kind, atom, gender=surrogates.gender_of(atom) if gender == "?" else gender)
        assert new != atom and any(c.isalnum() for c in new)
        if kind == "person" and atom[0].isalpha():
            assert new[0] != atom[0] and new[0] == surrogates.first_letter(surrogates.KEY, atom[0])


def test_names_that_once_had_no_other_form():
    for atom in ("'a", "''ann", "ta", "to", "zu", "ti", "林", "李明", "สมชาย", "محمد", "דוד", "x", "t", "z"):
        assert surrogates.replace_atom("person", atom) != atom
    assert surrogates.replace_atom("email", "at@test.com") != "at@test.com"
    assert surrogates.replace_atom("address", "rue de la") != "rue de la"
    assert {surrogates.first_letter(surrogates.KEY, c) for c in surrogates.CONSONANTS} == set(surrogates.CONSONANTS)


def test_formats_are_permuted_whole():
    numbers_ = [f"{k:04d}" for k in range(10_000)]
    new = [surrogates.replace_atom("id_number", n) for n in numbers_]
    assert sorted(new) == numbers_ and all(a != b for a, b in zip(new, numbers_))
    plates = [a + b + "7" for a in surrogates.CONSONANTS for b in surrogates.CONSONANTS]
    assert len({surrogates.replace_atom("id_number", p.upper()) for p in plates}) == len(plates)


def test_gender_and_order():
    found = entities.find("Signed off by Mrs. Karen Oduya, badge desk. Ask Mr. Luca Rossi about it. Witness: Rossi, Luca; done")
    assert [(e.text, e.gender) for e in found] == [("Karen Oduya", "f"), ("Luca Rossi", "m"), ("Rossi, Luca", "")]
    assert surrogates.genders("person", "Rossi, Luca", "") == ["", "?"] and surrogates.genders("person", "Luca B. Rossi", "m") == ["m", "", ""]
    assert surrogates.replace_atom("person", "karen", gender="f")[-1] in "ae" and surrogates.replace_atom("person", "luca", gender="m")[-1] not in "aei"


def test_rendered_surrogates_stay_apart(spark):
    """Names of few letters, whose surrogates collide at first: in the end, rendered, each has its own and none is real."""
    words = sorted({a + b + c + d for a in "bkt" for b in "aeiou" for c in "dlmnrs" for d in "aeio"})
    found = spark.createDataFrame([("person", [w], ["?"]) for w in words] * 2, "pii_kind string, atoms array<string>, genders array<string>")
    table = {r.atom: r.surrogate for r in surrogate_table(found).collect()}
    assert set(table) == set(words)
    shown = {surrogates.render("person", w.capitalize(), [n]) for w, n in table.items()}
    assert len(shown) == len(words) and not {s.lower() for s in shown} & set(words)


def test_a_secret_changes_everything(spark):
    assert surrogates.replace_atom("person", "zelma", key=b"a") != surrogates.replace_atom("person", "zelma", key=b"b")
    assert surrogates.tag("person", ["zelma"], b"a") != surrogates.tag("person", ["zelma"], b"b")
    spark.conf.set(KEY_SETTING, "secret")
    try:
        assert session_key(spark) == b"secret"
    finally:
        spark.conf.unset(KEY_SETTING)
