from fieldweave.llm import pieces


def test_words_are_encoded_once_and_alike(monkeypatch):
    """Repeated words cost one call of the model, also where the memory of words is full."""
    model = pieces.PieceModel.parse(pieces.read_model())
    tokenizer = pieces.build_tokenizer(model)
    texts = ["", " ", "a  b", "the the the the", "x" * 100, "  two   runs  ", "<s> <0x41> é\n\tñ 日本", "▁▁a ▁", "the end the"]
    whole = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    known: dict = {}
    assert pieces.encode_words(tokenizer, texts, known) == whole
    assert pieces.encode_words(tokenizer, texts, {}, plain=True) == whole
    assert "▁the" in known and "▁" + "x" * 100 not in known
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 2)
    small: dict = {}
    assert pieces.encode_words(tokenizer, texts, small) == whole and len(small) <= 2
