import pytest

from arkivist.llm import secret_scan


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ("passphrase: xqzjvkwpnbtrmf", "xqzjvkwpnbtrmf"), ("the password is xqzjvkwpnbtrmf", "xqzjvkwpnbtrmf"), ("auth token: x$9!kQ2#vL7p", "x$9!kQ2#vL7p"),
        ("secret password: h8$Kq!2#vLz9", "h8$Kq!2#vLz9"), ("bearer auth token -> x$9!kQ2#vL7p", "x$9!kQ2#vL7p"),
    ],
)
def test_values_in_all_contexts(text, secret):
    spans = [text[a:b] for k, a, b in secret_scan.find(text) if k == "guess"]
    assert spans == [secret]


def test_plain_words_after_a_blank_are_none():
    assert not secret_scan.find("the secret organisation and its token representative")
