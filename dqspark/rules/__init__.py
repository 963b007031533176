"""The rule language: specifications, text, parser, evaluator."""
