"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T


_DDL = {
    "images": "image_id long, path string, w int, h int, is_hdr boolean, is_srgb boolean, has_alpha boolean, tex_type string, layer int, face int, frame_no int",
    "pixels": "image_id long, mip int, x int, y int, r int, g int, b int, a int",
    "hdr_pixels": "image_id long, mip int, x int, y int, r float, g float, b float, a float",
    "slices": "file_id long, slice_idx int, image_idx int, mip int, alpha boolean, iframe boolean, orig_w int, orig_h int, w int, h int, nbx int, nby int, first_block long",
    "blocks": "file_id long, slice_idx int, block_idx long, bx int, by int, texels array<struct<r:int,g:int,b:int,a:int>>",
    "training": "vec_id long, features array<float>, weight long",
    "codebook": "kind string, code_id int, parent_id int, centroid array<float>, weight double",
    "encoder_blocks": "slice_idx int, bx int, by int, endpoint_idx int, selector_idx int, predictor int, is_cr_target boolean",
    "symbols": "stream string, slice_idx int, pos long, sym int",
    "code_lengths": "stream string, sym int, freq long, len int",
    "stats": "file_id long, slice_idx int, metric string, channel string, max double, mean double, mse double, rms double, psnr double",
    "golden": "file string, codec string, quality int, effort int, is_hdr boolean, size long, rgb_psnr double, rgba_psnr double, psnr2 double",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return sorted(_DDL)
