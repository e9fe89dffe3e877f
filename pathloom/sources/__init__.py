"""Graph file formats: .gr (binary CSR), MatrixMarket coordinate files, sidecars and text of distances."""
