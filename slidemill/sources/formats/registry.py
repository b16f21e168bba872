"""The supported formats: order, extension, label, and reader."""

#: Fixed values.
FORMATS = [
    (0, "csp", "CSP", "csp"),
    (1, "dmetrix", "DMETRIX", "dmetrix"),
    (2, "kfb", "KFB", "kfb"),
    (3, "mdss", "MDSS", "bkio"),
    (4, "mdsx", "MDSX", "bkio"),
    (5, "msdx", "MSDX", "bkio"),
    (6, "mrxs", "MRXS", "mrxs"),
    (7, "ndpi", "NDPI", "ndpi"),
    (8, "sdpc", "SDPC", "sdpc"),
    (9, "dyqx", "DYQX", "sdpc"),
    (10, "tif", "TIF/TIFF", "tiff"),
    (11, "tiff", "TIF/TIFF", "tiff"),
]
READERS = {extension: reader for _, extension, _, reader in FORMATS}
