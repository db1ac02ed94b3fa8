"""Production parameters of the registered queries and the pipeline."""

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
SEQUENCE = 2048
END_ID = 1
SHARDS = 40
LINE_DOCUMENTS = 10
SHINGLE_WORDS = 4  # of the near-duplicate query
STAGE_SHINGLE_WORDS = 5  # of the pipeline's stage
TOXIC = 0.3
SURROGATE_KEY = b"an example key; production passes its own"
RANKED = 20  # documents of a benchmark item
HAMMING_RADIUS = 7  # of 256 bits
