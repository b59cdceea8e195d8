import random
import string

import public_tokenizers
import pytest

from chatloom.llm import secrets

ALNUM = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, secrets.RATIO)


def share_found(scanner, letters, before="", after="", n=200):
    """How many of ``n`` random keys of 24 characters are inside a span, up to two characters at the ends."""
    draw, found = random.Random(3), 0
    for _ in range(n):
        text = f"see {before}{''.join(draw.choice(letters) for _ in range(24))}{after} there"
        start = len("see ") + len(before)
        found += any(s <= start + 2 and e >= start + 22 for s, _, e in scanner.added(text, scanner.base(text)))
    return found / n


NAMES = ["src/main/java/org/example/service", "antidisestablishmentarianism_in_words", "2021/11/04/19/00/00/index",
         "MAXIMUM_NUMBER_OF_RETRIES", "getCustomerAddress/setCustomerName", "internationalization"]


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase])
def test_random_keys_of_one_case_are_found(scanner, letters):
    assert share_found(scanner, letters) > 0.85


def test_names_of_words_are_no_secrets(scanner):
    for name in NAMES:
        assert scanner.added(name, scanner.base(name)) == [], name


@pytest.mark.parametrize("before", ["com/services/T00000000/B00000000/", "https/internal/build/artifacts/releases/", "/var/www/html/static/images/",
                                    "files/0123456789abcdef0123456789abcdef/", "configurationmanagement"])
def test_random_keys_behind_readable_parts_are_found(scanner, before):
    assert share_found(scanner, ALNUM, before) > 0.95
    assert share_found(scanner, ALNUM + "+/", before, "/index/pages") > 0.95


def test_identifiers_inside_paths_are_no_secrets(scanner):
    for part in ("e3b0c442-98fc-1c14-9afb-f4c8996fb924", "D41D8CD98F00B204E9800998ECF8427E"):
        text = f"internal/build/artifacts/releases/pages/documents/{part}/services/documents"
        assert scanner.added(text, scanner.base(text)) == []
