"""The registered queries, on the driver's tables as stand-ins; each module registers its own when imported."""
