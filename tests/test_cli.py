import os

import containers as K
from slidemill import cli


def test_info_convert_and_errors(spark, tmp_path, capsys):
    d = f"{tmp_path}/in"
    K.tiff(f"{d}/a.tif", [K.picture(150, 100), K.picture(75, 50)], strips=[("label", K.picture(40, 32, 2))])
    assert cli.main([d, "--info"], spark) == 0
    text = capsys.readouterr().out
    assert "Image : 150x100, tile=64x64, levels=2, compression=jpeg" in text and "L0=150x100 (3x2 tiles), L1=75x50 (2x1 tiles)" in text and "Assoc : label" in text and "app_mag=20" in text
    assert cli.main([d, "--output-dir", f"{tmp_path}/out", "--skip-associated"], spark) == 0
    assert os.listdir(f"{tmp_path}/out") == ["a.svs"] and "Done" in capsys.readouterr().out
    assert cli.main([d, "--quality", "0"], spark) == 1 and "quality" in capsys.readouterr().err
    assert cli.main([d, "--format", "kfb"], spark) == 1 and "not of format" in capsys.readouterr().err
    K.write(f"{d}/b.csp", b"x")
    assert cli.main([d, "--output-dir", f"{tmp_path}/out"], spark) == 1 and "b.csp" in capsys.readouterr().err
