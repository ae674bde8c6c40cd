import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwarden.llm.encode import Encoder
from driftwarden.llm.words import SPACE_BYTES, Words

ODD = [" ", "  ", "\n", "\t", ".", ",", "word", "The", "'s", "don't", " ", "é", "é", "123", "...", "!", "<|endoftext|>"]
ODD += ["<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "</w>"]
ODD += ["\x01", "\x00", "　", "漢字", "🙂", "\r\n", "ſ", "İ", "́", "Σς", "क़.", "a.̸"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(ODD[6:10]) for _ in range(50)) for _ in range(200)] + [None, "", " ", "\n", "a ", " a"]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|><|endoftext|>.b", "x" * 3000 + "<|endoftext|>\n<|startoftext|>"]
    encode, plain = Encoder(public_tokenizers.path(name), kept=500), Tokenizer.from_file(public_tokenizers.path(name))
    for text, ids in zip(texts, encode.encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_new_words_go_to_the_tokenizer_as_they_are():
    """Nothing is put between new words where ids spell bytes; an id that reached over a word's end would be noticed."""
    encode, sent = Encoder(public_tokenizers.path("byte_bpe_50k.json")), []

    class Spy:
        def encode_batch_fast(self, rows, **options):
            sent.extend(rows)
            return plain.encode_batch_fast(rows, **options)

        def encode(self, text, **options):
            return plain.encode(text, **options)

    plain, encode.tokenizer = encode.tokenizer, Spy()
    text = "".join(f" wört{i}x{i * i}" for i in range(500))
    (ids,) = encode.encode(pa.array([text]))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(map(len, sent)) == len(text)
    encode.bytes[ids[:1]] += 1
    encode._reset()
    (again,) = encode.encode(pa.array([text]))
    assert again.tolist() == ids.tolist()


def test_words_are_those_of_split():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé ") for _ in range(rng.randint(0, 12))).encode() for _ in range(500)]
    words = Words(texts, SPACE_BYTES)
    found = [words.raw[a:b] for a, b in zip(words.starts, words.ends)]
    assert [found[f:p] for f, p in zip(words.first, words.past)] == [t.split(None) for t in texts]
    hashes = words.hashes().tolist()
    assert len(set(zip(found, hashes))) == len(set(found)) == len(set(hashes))
