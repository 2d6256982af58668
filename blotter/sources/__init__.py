"""Input relations: schemas, the catalog, and derived test fixtures."""
