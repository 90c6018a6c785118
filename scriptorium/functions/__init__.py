"""Column -> Column building blocks: text cleaning and metadata (``text``),
prompts (``prompts``), answer parsing (``answers``) and the fixed output
values (``fixed``)."""
