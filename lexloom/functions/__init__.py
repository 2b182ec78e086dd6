"""Column functions: words, ASCII case, Unicode, stemming, hashes."""
