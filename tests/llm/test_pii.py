from codeloam.llm import pii

KNOWN = {"tavrin", "oskeld", "mirelo"}


def found(text, known=KNOWN):
    return [(text[b:e], k) for b, e, k in pii.find_spans(text, known)]


def test_kinds():
    text = "Signed-off-by: Tavrin van-Brelk <t.o+scan@mail.lume.test>\ntel (930) 555 0185 ext. 19\nFlat 2, 183 Rookfield Rd\nSSN: 000-69-6769"
    assert found(text) == [("Tavrin van-Brelk", "person_name"), ("t.o+scan@mail.lume.test", "email"), ("(930) 555 0185 ext. 19", "phone"), ("Flat 2, 183 Rookfield Rd", "address"), ("000-69-6769", "id_number")]


def test_phone_begins():
    for text, number in [("ask X (+1 848 555 0109)", "+1 848 555 0109"), ("or ((911) 555 0100)", "(911) 555 0100"), ("+999 (0)57 / 951930-1", "+999 (0)57 / 951930-1"), ("call 00999 56 4394962.", "00999 56 4394962"), ("at 15985550153", "15985550153")]:
        assert found(text) == [(number, "phone")], text


def test_disguises_keep_offsets():
    text = "write a.b at post dot tarn dot test, c [at] box [dot] orrin [dot] example or d(at)quill.invalid; zero one two three four five six"
    assert [x for x, k in found(text) if k == "email"] == ["a.b at post dot tarn dot test", "c [at] box [dot] orrin [dot] example", "d(at)quill.invalid"]
    plain, first, last = pii.normalise(text)
    assert "0123456" in plain and len(plain) == len(first) == len(last)
    wide = "ｔａｖ@box.orrin.test​ and p​a@quill.test"
    assert [x for x, _ in found(wide)] == ["ｔａｖ@box.orrin.test", "p​a@quill.test"]
    cyr = "mаil: рa@quill.test"
    assert found(cyr) == [("рa@quill.test", "email")]


def test_no_cases():
    for text in ["@pellweave0 wrote on app/trace.go:10", "Clone git@forge.rudder.example:page/path.git", "Install seam-kit@7.40.4", "@property hides it", "It listens on 10.27.14.52:8043.", "Build 2031021-54-24 passed.", "Timer values: 65 31 792 21.", "Lines 33-1887 on Harbor Street View were striped.", "Merge Sort and Quick Scan are both O(n^2).", "Blue Lantern is the code name of the slot", "x = 1205550 + 3"]:
        assert found(text) == [], text


def test_names_by_context_or_part():
    assert found("Thanks to Kessandra Kestromar for the sample.", set()) == [("Kessandra Kestromar", "person_name")]
    assert found("Ask Oskeld, Tavrin before you touch it") == [("Oskeld, Tavrin", "person_name")]
    assert found("Dr. Mirelo O'Tarvane-Oskeld signed the audit") == [("Mirelo O'Tarvane-Oskeld", "person_name")]
    assert found("-- \nPelvik K. Varn\n", set()) == [("Pelvik K. Varn", "person_name")]
    assert found("mail tavrin.oskeld@box.test") == [("tavrin.oskeld@box.test", "email")]


def test_masking_round_trip():
    text = "a  call (930) 555 0185 or x@y.test \U0001f600 end"
    spans = pii.find_spans(text, KNOWN)
    assert pii.masked(text, spans) == "a  call [PHONE] or [EMAIL] \U0001f600 end"
    rebuilt, at = "", 0
    for b, e, _ in spans:
        rebuilt += text[at:b] + text[b:e]
        at = e
    assert rebuilt + text[at:] == text


def test_table(spark):
    long = "word " * 200_000 + "x@y.test"
    rows = [(1, None, 1), (2, "", 1), (3, "x@y.test", 1), (3, "x@y.test", 1), (None, "x@y.test", 1), (4, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    names = spark.createDataFrame([("Tavrin", "given"), (None, None)], "name_part string, part_kind string")
    got = {(r.doc_id, r.masked): len(r.spans) for r in pii.mask_documents(docs, names).collect()}
    assert got == {(1, None): 0, (2, ""): 0, (3, "[EMAIL]"): 1, (None, "[EMAIL]"): 1, (4, "word " * 200_000 + "[EMAIL]"): 1}
    assert pii.mask_documents(docs, names).count() == 6
    assert pii.mask_documents(docs.limit(0), names.limit(0)).count() == 0


def test_accented_names_and_disguises_in_capitals():
    shown = lambda text: [(text[b:e], k) for b, e, k in pii.find_spans(text)]
    assert shown("Regards,\nMaría García\n") == [("María García", "person_name")]
    assert shown("Hi Łukasz Nowak, the build is red") == [("Łukasz Nowak", "person_name")]
    assert shown("Signed-off-by: José Álvarez") == [("José Álvarez", "person_name")]
    assert shown("According to Maria Lopez, it fails") == [("Maria Lopez", "person_name")]
    assert shown("mail john.doe AT example DOT com please") == [("john.doe AT example DOT com", "email")]
