"""Settings of the ranking pipeline."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Params:
    """Names and defaults are those users of such pipelines pass on the command line."""

    type: str = "all"
    trn_X_Xf: str = ""
    tst_X_Xf: str = ""
    trn_X_Y: str = ""
    tst_X_Y: str = ""
    Y_Yf: str = ""
    Xf: str = ""
    Yf: str = ""
    propensity_A: float = 0.55
    propensity_B: float = 1.5
    sparsity_pattern_file: str = ""
    bs_count: int = 10
    bs_threshold: float = 0.0
    bs_alpha: float = 0.2
    bs_direct_wt: float = 0.2
    binary_relevance: bool = True
    score_alpha: float = 0.9
    F: int = 10
    shortyK: int = 100
    bilinear_add_bias: bool = False
    bilinear_normalize: bool = True
    bilinear_classifier_kind: int = 0
    bilinear_classifier_maxitr: int = 20
    bilinear_classifier_pos_wt: float = 1.0
    bilinear_classifier_cost: float = 1.0
    num_thread: int = 1
    res_dir: str = "Results"
    model_dir: str = "Results/model"

    def __post_init__(self):
        if self.bilinear_classifier_kind not in (0, 1):
            raise ValueError("bilinear_classifier_kind must be 0 (squared hinge) or 1 (logistic)")
        if self.type not in ("all", "train", "predict", "xhtp_approx", "xhtp_fine_tune"):
            raise ValueError(f"no such type: {self.type}")

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def parse(cls, args: list[str]) -> Params:
        """From `-name value` pairs, later ones replacing earlier ones; `@file` reads such pairs from a file."""
        kinds = {"float": float, "int": int, "str": str, "bool": lambda s: {"0": False, "false": False, "1": True, "true": True}[s.lower()]}
        parser = argparse.ArgumentParser(prefix_chars="-", fromfile_prefix_chars="@", allow_abbrev=False)
        parser.convert_arg_line_to_args = lambda line: [f"-{w}" if k == 0 and not w.startswith("-") else w for k, w in enumerate(line.split())]
        for f in fields(cls):
            parser.add_argument(f"-{f.name}", f"--{f.name}", dest=f.name, type=kinds[f.type], default=f.default)
        return cls(**vars(parser.parse_args(args)))
