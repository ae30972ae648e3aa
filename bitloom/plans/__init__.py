"""Plans that take many steps: random starts, sweeps over factors and core, factorization."""
