from foliant.llm import media


def test_thumbnail_hash_covers_all_images(monkeypatch):
    """Texts that differ only after their first image have thumbnail hashes of their own."""
    monkeypatch.setattr(media, "IMAGE_BYTES", 4096)
    start = bytes(range(32, 96)) * 64
    texts = [start, start + b"az" * 2000, start + bytes(range(96, 32, -1)) * 60]
    rows = media._features([1, 2, 3], [media.encode_payload(t) for t in texts]).to_pylist()
    assert [r["images"] for r in rows] == [1, 2, 2]
    hashes = [r["thumbnail_hash"].split("-") for r in rows]
    assert [len(h) for h in hashes] == [1, 2, 2] and len({h[0] for h in hashes}) == 1 and hashes[1][1] != hashes[2][1]
