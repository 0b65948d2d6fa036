"""op10: names, digits and secrets of other scripts are replaced, in their own script."""

import unicodedata

import pytest

from tessera.llm import pii

MAKER = pii.Surrogates(b"test key")
NAMES = ["Dr Παπαδόπουλος", "Mr 王小明", "Mrs გიორგაძე", "Dr Նազարյան", "Mr Ñçßø", "Dr משהכהן", "Г-н Ёжъй", "Mr İzmir", "Dr 김철수"]
DIGITS = {
    "card": "٤١١١١١١١١١١١١١١١ and ４１１１ １１１１ １１１１ １１１１ and ४१११११११११११११११",
    "phone": "(३८६) ५५५-३७३३ and 386-555-３７３３ and +٤٩ ٣٠ ١٢٣٤٥٦٧",
    "ssn": "١٢٣-٤٥-٦٧٨٩",
    "ipv4": "1.2.3.٤",
    "iban": "DE٨٩ 3704 0044 0532 0130 00",
}


@pytest.mark.parametrize("text", NAMES)
def test_names_of_other_scripts_change(text):
    out, entities = pii.redact(text, MAKER)
    old, new = text.split(" ")[1], out.split(" ")[1]
    script = lambda c: unicodedata.name(c).split(" ")[0]
    assert [e[0] for e in entities] == ["name"] and old != new and len(old) == len(new)
    assert list(map(script, old)) == list(map(script, new))


@pytest.mark.parametrize("kind", DIGITS)
def test_digits_of_other_scripts_change(kind):
    text = DIGITS[kind]
    out, entities = pii.redact(text, MAKER)
    assert {e[0] for e in entities} == {kind} and len(entities) == text.count(" and ") + 1
    for old, new in zip(text.split(" and "), out.split(" and "), strict=True):
        assert old != new
        if kind != "ipv4":
            assert [c.isascii() for c in old] == [c.isascii() for c in new]


def test_digits_mean_the_same_in_every_script():
    plain, wide = "4111111111111111", "４１１１１１１１１１１１１１１１"
    assert pii.redact(plain, MAKER)[0] == unicodedata.normalize("NFKC", pii.redact(wide, MAKER)[0])


def test_secrets_always_change_and_letters_stay_one_to_one():
    for text in ("password=секретъ", "password=秘密秘密", "password=••••"):
        assert pii.redact(text, MAKER)[0] != text
    made = [MAKER.replace("name", a + b) for a in pii.alphabet("α") for b in pii.alphabet("ς")]
    assert len(set(made)) == len(made)
