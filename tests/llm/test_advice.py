"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from test_kernels import one_run

from urlsight.llm import packing, pii, quality, queries


def accounts(text):
    return [text[a:b] for a, b in pii.accounts(text)]


@pytest.mark.parametrize("number", [
    "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00",
    "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947", "BE68539007547034",
])
@pytest.mark.parametrize("after", ["", ".", " BIC GEBABEBB", " OK", " 2024", " A", " and", " BANKING 12", " DE89 3704 0044 0532 0130 00"])
def test_account_numbers_end_where_they_end(number, after):
    found = accounts(f"IBAN {number}{after}")
    assert found[0] == number
    assert len(found) == 1 + (" DE89" in after)


def test_false_account_numbers_are_not_cut_until_one_passes():
    assert accounts("BE68 5390 0754 7035 BIC GEBABEBB") == []
    assert accounts("AB12 3456 7890 CD34 BE68 5390 0754 7034 OK") == ["BE68 5390 0754 7034"]


def kept(words):
    return bool(quality.measures(one_run([" ".join(words)]), quality.Rules())["kept"][0])


def test_a_sentence_said_twice_does_not_cost_a_short_text():
    for count in (51, 60, 87, 130):
        for size in (8, 10, 13, 20):
            sentence = [f"s{k}" for k in range(size)]
            rest = [f"w{k}" for k in range(count - 2 * size)]
            assert kept([*sentence, *rest, *sentence]) or 2 * (2 * size) > count


def test_long_and_many_repeats_still_cost_a_text():
    words = [f"w{k}" for k in range(70)]
    assert not kept([*words, *words[:30]])
    sentences = [[f"{c}{k}" for k in range(9)] for c in "abcdef"]
    assert not kept([w for s in sentences for w in s] + [f"w{k}" for k in range(120)] + [w for s in sentences for w in s])


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>" * 3, "<|endoftext"])
def test_added_tokens_have_their_own_ids(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    encoder = packing.Encoder(path)
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert encoder.ids(text).tolist() == [*expected, packing.END]
    assert np.isin(50256, encoder.ids(text)) == ("<|endoftext|>" in text)
