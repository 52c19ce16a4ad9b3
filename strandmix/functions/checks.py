"""Argument checks, made on the driver before any plan is built."""

from __future__ import annotations

import warnings

MODEL_TYPES = ("mfa", "mpca")
#: Old names of arguments and what they are called now.
RENAMED = {"nIterFA": "iter_fa", "nIterPCA": "iter_pca", "max_iterations": "max_iter", "subject_rdim_for_kmeans": "kmeans_rdim", "nc_cores": "n_cores"}


def positive_int(name: str, value) -> int:
    """The value, if it is a whole number of at least one."""
    if isinstance(value, bool) or int(value) != value or value < 1:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return int(value)


def model_params(n_clusters, n_factors, n_init=1, max_iter=50, tol=1e-3) -> None:
    """Whole positive numbers, a positive number of rounds and a positive tolerance."""
    for name, value in (("n_clusters", n_clusters), ("n_factors", n_factors), ("n_init", n_init), ("max_iter", max_iter)):
        positive_int(name, value)
    if not tol > 0:
        raise ValueError(f"tol must be positive, not {tol!r}")


def fits_data(n_clusters: int, n_subjects: int, n_factors: int, n_channels: int) -> None:
    """No more clusters than subjects, no more factors than channels."""
    if n_clusters > n_subjects:
        raise ValueError(f"{n_clusters} clusters for {n_subjects} subjects")
    if n_factors > n_channels:
        raise ValueError(f"{n_factors} factors for {n_channels} channels")


def model_type(name: str) -> str:
    """The name in lower case, if it is a known one."""
    if str(name).lower() not in MODEL_TYPES:
        raise ValueError(f"model type must be one of {', '.join(MODEL_TYPES)}, not {name!r}")
    return str(name).lower()


def renamed(kwargs: dict) -> dict:
    """Arguments under their present names; an old name warns, and gives way to the new one where both are there."""
    out = {k: v for k, v in kwargs.items() if k not in RENAMED}
    for old, new in RENAMED.items():
        if old in kwargs:
            warnings.warn(f"{old} is now {new}", DeprecationWarning, stacklevel=3)
            out.setdefault(new, kwargs[old])
    return out


def fit_object(fit, kind: str | None = None, required: tuple[str, ...] = ()) -> str:
    """The model type of a fit: what it says, or ``kind``, which warns where the fit says otherwise. ValueError for what is no fit.

    A fit has components with a mean, loadings and noise of the same channels, one prior for each, and the ``required`` attributes.
    """
    import numpy as np

    if missing := [x for x in ("kind", "components", "pi", *required) if getattr(fit, x, None) is None]:
        raise ValueError(f"not a fit, or one without {', '.join(missing)}")
    if not len(fit.components) or len(fit.pi) != len(fit.components):
        raise ValueError(f"{len(fit.components)} components and {len(fit.pi)} priors")
    shapes = {np.shape(c.loadings) for c in fit.components}
    if len(shapes) != 1 or any(len(c.mean) != np.shape(c.loadings)[0] or len(c.noise) != np.shape(c.loadings)[0] for c in fit.components):
        raise ValueError("components of different shapes")
    found = model_type(fit.kind)
    if kind is not None and model_type(kind) != found:
        warnings.warn(f"a fit of {found} taken for {model_type(kind)}", UserWarning, stacklevel=2)
        return model_type(kind)
    return found
