"""Operations of a training-data pipeline: sharding, packing, scans,
fingerprints, deduplication, decontamination and quality selection.

Nothing else in the library imports this subpackage.
"""
