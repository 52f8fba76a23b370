"""All tunable parameters of a verification run, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class VerifyConfig:
    """Which stage variant to use and with which sizes.

    Defaults give the deterministic native run; ``scorer``, ``extractor``,
    ``rewriter`` and ``encoder`` accept a plugged model (see ``attesta.operators.relation``,
    ``attesta.operators.segment``, ``attesta.operators.context`` and
    ``attesta.operators.dense``); ``encoder="hashed"`` ranks source claims by hashed vectors.
    """

    # segmentation
    chunk_size: int = 1000
    chunk_overlap: int = 200
    split_chunks: bool = False          # claims straight from sentences unless set
    min_claim_tokens: int = 1

    # claim post-processing
    decontextualise: bool = False
    check_falsifiability: bool = False
    clean_prefixes: bool = False

    # corpus search
    search_results: int = 10
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    max_df_share: float | None = None   # None: no search term is dropped for being frequent

    # evidence
    nearest_k: int = 5
    embed_source_claims: bool = True    # False: every claim of a hit is compared
    tile_rows: int = 256                # source claims held by one row of the join
    hot_key_rows: int = 1_000           # hits on one source that travel together
    wave_ranks: tuple = (3,)            # last search ranks of the waves in which hits are compared; () compares all at once
    wave_least_hits: int = 1_000_000    # fewer hits are compared at once
    extract_sources: bool = False       # True: sources go through the same chain as articles, not only the sentence cut
    require_reliable: bool = False

    # plug points
    extractor: object = None
    rewriter: object = None
    batch_rewriter: object = None       # as rewriter, but one call for a step of many articles
    scorer: object = None
    encoder: object = None              # None: source claims are ranked by shared words
    labels: tuple = field(default=("contradiction", "entailment", "neutral"))
